"""Language plug-ins: a column that is there, or naive Bayes over tokens as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import RANK_DIGITS
from .lexical import term_frequencies
from .sizes import broadcast_up_to

UNDETERMINED = "und"


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing, trained and applied relationally."""

    def __init__(self, labelled: DataFrame, text: str = "text", label: str = "language"):
        tf = term_frequencies(labelled, text, ("id", label))
        self.counts = tf.groupBy(F.col(label).alias("language"), "term").agg(F.sum("tf").alias("c"))
        vocabulary = self.counts.select("term").distinct().agg(F.count(F.lit(1)).alias("v"))
        priors = labelled.groupBy(F.col(label).alias("language")).agg(F.count(F.lit(1)).alias("docs"))
        totals = self.counts.groupBy("language").agg(F.sum("c").alias("tokens"))
        n = priors.agg(F.sum("docs").alias("n"))
        # a row a language
        self.languages = priors.join(totals, "language").crossJoin(F.broadcast(vocabulary)).crossJoin(F.broadcast(n)).select("language", F.log(F.col("docs") / F.col("n")).alias("prior"), F.log((F.col("tokens") + F.col("v")).cast("double")).alias("floor"))

    def save(self, path: str) -> None:
        """Store the model, so that its counts are made once."""
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        self.languages.write.mode("overwrite").parquet(f"{path}/languages")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NaiveBayes:
        model = cls.__new__(cls)
        model.counts, model.languages = (spark.read.parquet(f"{path}/{name}") for name in ("counts", "languages"))
        return model

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(id, language): the most probable, ties to the smaller name; ``und`` with no token.

        A term unknown in a language adds the language's floor alone, so only known terms are
        joined; sums are per (document, language) and partial before the shuffle.
        """
        tf = term_frequencies(docs, text)
        dl = tf.groupBy("id").agg(F.sum("tf").alias("dl"))
        known = tf.join(broadcast_up_to(self.counts, 1_000_000), "term").groupBy("id", "language").agg(F.sum(F.col("tf") * F.log(F.col("c") + 1.0)).alias("s"))
        each = dl.crossJoin(broadcast_up_to(self.languages, 10_000)).join(known, ["id", "language"], "left")
        each = each.withColumn("score", F.col("prior") + F.coalesce("s", F.lit(0.0)) - F.col("dl") * F.col("floor"))
        order = Window.partitionBy("id").orderBy(F.desc(F.round("score", RANK_DIGITS)), "language")
        best = each.withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "language")
        return docs.select("id").join(best, "id", "left").select("id", F.coalesce("language", F.lit(UNDETERMINED)).alias("language"))
