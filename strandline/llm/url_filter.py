"""URL rules looked up through a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# fixed values: the rules of the contract as (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 23  # 64-bit blocks, so the broadcast filter never exceeds 64 MB; full size for 33 M keys
SHELF = 1 << 16  # blocks that one task puts together
PROBES = 4
BROADCAST_BYTES = 32 << 20  # rules up to this size go to every task
COMMON = 1000  # a key with over 1 / COMMON of the hits is joined by itself; there are fewer than COMMON


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """PROBES bits of one 64-bit block, from a second hash."""
    h = F.xxhash64(key, F.lit(7))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row, (bloom, hit): the filter's words as an array of shelves. Linear in the keys: words
    are combined by block, and each shelf of the array is put together by a task of its own."""
    words = listed.groupBy(_block(F.col("key"), blocks).alias("b")).agg(F.bit_or(_mask(F.col("key"))).alias("w"))
    every = listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("b"))
    filled = every.join(words, "b", "left").select(F.expr(f"b div {SHELF}").alias("shelf"), "b", F.coalesce("w", F.lit(0).cast("long")).alias("w"))
    shelf = filled.groupBy("shelf").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("words"))
    return shelf.agg(F.transform(F.array_sort(F.collect_list(F.struct("shelf", "words"))), lambda x: x["words"]).alias("bloom")).withColumn("hit", F.lit(True))


def _looked_up(probed: DataFrame, listed: DataFrame, small: bool) -> DataFrame:
    """Rows of ``probed`` (key is null unless it passed the filter) with the rule of their key.

    Rules that fit a broadcast meet each row where it is. Otherwise only rows with a key are
    joined, keys with very many rows (such as a whole top-level domain) apart from the others.
    """
    if small:
        return probed.join(F.broadcast(listed), "key", "left")
    probed = stage(probed, "url-keys")
    hits = probed.where("key is not null")
    total = hits.count()
    common = hits.groupBy("key").count().where(F.col("count") * COMMON > total).select("key")
    common = stage(common.withColumn("common", F.lit(True)), "common-keys")  # under COMMON rows
    marked = hits.join(F.broadcast(common), "key", "left")
    few = F.broadcast(listed.join(F.broadcast(common.select("key")), "key", "left_semi"))
    of_common = marked.where("common").drop("common").join(few, "key", "left")
    of_others = marked.where("common is null").drop("common").join(listed, "key", "left")
    rest = probed.where("key is null")
    for name in listed.columns:
        if name != "key":
            rest = rest.withColumn(name, F.lit(None).cast(listed.schema[name].dataType))
    return of_common.unionByName(of_others).unionByName(rest)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each URL by the longest listed rule that fits it; ``default`` where none fits.

    ``rules`` has verdict, host, path. Each URL is canonicalised to (host, path) and expanded to
    the keys that could be listed: every suffix of the host at a dot, joined with every prefix of
    the path whose length some rule has. A blocked Bloom filter of the listed keys (one 64-bit
    word per key, at most MAX_BLOCKS words) is broadcast; it is a join condition, so no row carries
    it. Keys it passes go to an exact hash join with the rules, which removes false positives; see
    `_looked_up` for big rule lists and hot hosts. Results meet per row.

    Returns page_id, host, path, rule, verdict. Defined cases: a null URL or one without ://
    has empty host and path and gets the default; rules with a null part are ignored; of equal
    rules the smallest verdict holds; repeated rows are judged each; no rules or no pages work.
    """
    listed = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    listed = listed.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), F.concat_ws("\x00", "host", "path").alias("key"), "verdict")
    # distinct path lengths: bounded by the longest listed path, not by the number of rules
    size = F.sum(F.octet_length("key") + F.octet_length("rule") + 64)
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("path_len")).alias("lens")).first()
    blocks = min(MAX_BLOCKS, max(1, -(-facts["n"] * BITS_PER_KEY // 64)))
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("rid"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lens = F.array(*[F.lit(n) for n in facts["lens"]]).cast("array<int>")
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(lens, lambda n: n <= F.length("path")), lambda n: F.concat(s, F.lit("\x00"), F.substring(F.col("path"), F.lit(1), n)))))
    rows = rows.withColumn("keys", F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>")))
    each = rows.select("rid", "page_id", "host", "path", F.explode_outer("keys").alias("key"))
    block = _block(F.col("key"), blocks)
    word = F.get(F.get("bloom", F.shiftright(block, SHELF.bit_length() - 1)), block.bitwiseAND(F.lit(SHELF - 1)))
    probed = each.join(F.broadcast(_filter(listed, blocks)), word.bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")), "left")
    probed = probed.select("rid", "page_id", "host", "path", F.when(F.col("hit"), F.col("key")).alias("key"))
    hits = _looked_up(probed, listed, facts["bytes"] <= BROADCAST_BYTES)
    best = F.max_by(F.struct("rule", "verdict"), F.when(F.col("rule").isNotNull(), F.struct(F.col("host_len") + F.col("path_len"), "host_len")))
    judged = hits.groupBy("rid", "page_id", "host", "path").agg(best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in RULES])))
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
ORACLE_SQL = f"""
with rules(verdict, rhost, rpath) as (values {", ".join(str(r) for r in RULES)}),
p as (select row_number() over () rid, page_id, {_HOST} host, {_PATH} path from pages),
fit as (
  select p.*, rhost || rpath as rule, r.verdict, row_number() over (partition by rid order by length(rhost || rpath) desc nulls last, length(rhost) desc) k
  from p left join rules r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from fit where k = 1
"""
