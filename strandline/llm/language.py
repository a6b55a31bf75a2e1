"""Language identification by a byte convolutional network, trained here in numpy."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bytes, free_name, slices, utf8, with_struct

WIDTHS = (2, 3, 4)  # bytes that a filter sees
FILTERS = 16  # filters of each width
LENGTH = 128  # bytes of a window
DOCS_PER_LANGUAGE = 500  # labelled documents that training reads, at most
WINDOWS_PER_DOC = 4
MOST_LABELS = 10_000  # more distinct labels than this are no languages: an error
STEPS, BATCH, RATE = 700, 64, 0.15  # STEPS for each LABELS_PER_STEPS languages
LABELS_PER_STEPS = 16
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LETTERS = np.zeros(256, np.float32)
_LETTERS[ord("a") : ord("z") + 1] = _LETTERS[0x80:] = 1


@dataclass
class Model:
    languages: list[str]
    filters: list[np.ndarray]  # per width: (width, 256, FILTERS), one-hot bytes in
    shift: np.ndarray  # bias of each filter
    out: np.ndarray  # (filters, languages)
    bias: np.ndarray


def windows(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Cut each text into windows of ``length`` folded bytes, zeros at its end; one at least.

    Returns the windows with max(WIDTHS) - 1 bytes of what follows, and the text of each.
    """
    sizes = np.diff(offsets)
    per = np.maximum(1, -(-sizes // length))
    text = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[:-1][text] + nth * length
    span = length + max(WIDTHS) - 1
    at = begin[:, None] + np.arange(span)[None, :]
    inside = at < offsets[1:][text][:, None]
    padded = np.append(_FOLD[raw], np.uint8(0))
    at[~inside] = len(raw)
    return padded[at], text


class Scorer:
    """The network's forward pass with filters of two bytes at a time as tables."""

    def __init__(self, model: Model):
        self.model = model
        self.pairs = []
        for f in model.filters:
            tables = [(f[o][:, None, :] + f[o + 1][None, :, :]).reshape(65536, -1) for o in range(0, len(f) - 1, 2)]
            self.pairs.append((tables, f[-1] if len(f) % 2 else None))

    def pooled(self, w: np.ndarray) -> np.ndarray:
        span = w.shape[1] - max(WIDTHS) + 1
        pair = w[:, :-1].astype(np.uint16) * np.uint16(256) + w[:, 1:]
        out = []
        for (tables, single), width in zip(self.pairs, WIDTHS, strict=True):
            y = np.take(tables[0], pair[:, :span], axis=0)
            for i, t in enumerate(tables[1:], 1):
                y += np.take(t, pair[:, 2 * i : 2 * i + span], axis=0)
            if single is not None:
                y += np.take(single, w[:, width - 1 : width - 1 + span], axis=0)
            out.append(y.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1) + self.model.shift, 0)

    def probabilities(self, w: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(w), 48):  # so many that a layer stays in the cache
            z = self.pooled(w[i : i + 48]) @ self.model.out + self.model.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def train(samples: list[tuple[str, bytes]], seed: int = 11) -> Model | None:
    """Fit the network to (language, bytes) samples by Adagrad; None without samples."""
    samples = [s for s in samples if s[1]]
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum([min(len(s[1]), LENGTH) for s in samples])])
    w, _ = windows(np.frombuffer(b"".join(s[1][:LENGTH] for s in samples), np.uint8), offsets)
    label = np.array([languages.index(s[0]) for s in samples])
    by = [np.flatnonzero(label == k) for k in range(len(languages))]
    filters = [rng.normal(0, 0.3, (n, 256, FILTERS)).astype(np.float32) for n in WIDTHS]
    shift = np.zeros(FILTERS * len(WIDTHS), np.float32)
    out = rng.normal(0, 0.3, (len(shift), len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    model = Model(languages, filters, shift, out, bias)
    seen = [np.full(p.shape, 1e-2, np.float32) for p in (*filters, shift, out, bias)]
    lanes = np.arange(FILTERS)

    def move(p, total, g):
        total += g * g
        p -= RATE * g / np.sqrt(total)

    for _ in range(STEPS * -(-len(languages) // LABELS_PER_STEPS)):
        pick = np.concatenate([rng.choice(by[k], max(1, BATCH // len(by))) for k in rng.permutation(len(by))[:BATCH]])
        x, y = w[pick], label[pick]
        short = rng.random(len(pick)) < 0.3  # short texts too
        cut = rng.integers(8, LENGTH, len(pick))
        x = np.where(short[:, None] & (np.arange(x.shape[1])[None, :] >= cut[:, None]), 0, x).astype(np.uint8)
        best, where = [], []
        for f in filters:
            z = sum(f[o][x[:, o : o + LENGTH]] for o in range(len(f)))
            at = z.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
        pre = np.concatenate(best, axis=1) + shift
        hidden = np.maximum(pre, 0)
        z = hidden @ out + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ out.T) * (pre > 0)
        for k, (f, at) in enumerate(zip(filters, where, strict=True)):
            g = np.zeros_like(f)
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for o in range(len(f)):
                np.add.at(g[o], (np.take_along_axis(x, at + o, axis=1), lanes[None, :]), part)
            move(f, seen[k], g)
        move(shift, seen[-3], back.sum(0))
        move(out, seen[-2], hidden.T @ d)
        move(bias, seen[-1], d.sum(0))
    return model


def learned_rows(docs: DataFrame, id_col: str) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 != 2


def samples_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """A bounded sample: windows at hashed places of at most ``per_language`` texts a label.

    Every label is learned; a column with over MOST_LABELS of them raises ValueError.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & learned_rows(rows, "id"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("labelled"))
    labels = counts.limit(MOST_LABELS + 1).count()
    if labels > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {lang_col}")
    key = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
    rate = F.least(F.lit(1.0), F.lit(1.3 * per_language) / F.col("labelled"))
    most = 2 * per_language * labels
    chosen = rows.join(F.broadcast(counts), "lang").where(key < rate * (1 << 30)).where("text is not null and text <> ''")
    places = F.array(*[F.pmod(F.xxhash64("id", F.lit(i + 10)), F.greatest(F.length("text") - LENGTH // 2, F.lit(1))) for i in range(WINDOWS_PER_DOC)])
    chosen = chosen.select("lang", key.alias("key"), F.transform(places, lambda p: F.substring(F.col("text"), (p + 1).cast("int"), F.lit(LENGTH))).alias("parts"))
    out, taken = [], {}
    for r in chosen.orderBy("key", "lang", "parts").limit(most).collect():
        taken[r["lang"]] = n = taken.get(r["lang"], 0) + 1
        if n <= per_language:
            out += [(r["lang"], p.encode()) for p in dict.fromkeys(r["parts"]) if any(map(str.isalpha, p))]
    return out


_scorers: dict = {}


def with_language(docs: DataFrame, out: str, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add struct column ``out`` (lang, score, sure): the whole text's language, without a shuffle.

    Every window of a text is scored; a text's probabilities are the mean of its windows',
    weighted by their letter bytes. ``sure`` is the mean of each window's best probability, whatever
    the window's language, so it is high for a clean text in several languages too. Null texts, and
    texts with no letter, are ``und`` with score and sure 0, as is everything when there is no model.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    sent = spark.sparkContext.broadcast(model)  # about 150 kB and 200 bytes a language
    mark = uuid.uuid4().hex

    def made(columns):
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(sent.value) if sent.value else None
        scorer = _scorers[mark]
        raw, offsets = utf8(columns[0])
        letters = [t is not None and any(c.isalpha() for c in t) for t in columns[0].to_pylist()]
        langs, scores, sures = [], [], []
        for a, b in slices(offsets, 1 << 18) if scorer else []:
            part = offsets[a : b + 1] - offsets[a]
            w, text = windows(raw[offsets[a] : offsets[b]], part)
            p = scorer.probabilities(w)
            weight = _LETTERS[w[:, :LENGTH]].sum(axis=1) + 1e-3
            first = np.searchsorted(text, np.arange(b - a))
            mean = np.add.reduceat(p * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
            sure = np.add.reduceat(p.max(axis=1) * weight, first) / np.add.reduceat(weight, first)
            best = mean.argmax(axis=1)
            langs += [scorer.model.languages[k] for k in best]
            scores += mean[np.arange(b - a), best].tolist()
            sures += sure.tolist()
        if not scorer:
            langs, scores, sures = [UNDETERMINED] * len(letters), [0.0] * len(letters), [0.0] * len(letters)
        langs = [x if ok else UNDETERMINED for x, ok in zip(langs, letters, strict=True)]
        scores = [min(1.0, max(0.0, x)) if ok else 0.0 for x, ok in zip(scores, letters, strict=True)]
        sures = [min(1.0, max(0.0, x)) if ok else 0.0 for x, ok in zip(sures, letters, strict=True)]
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sures, pa.float64())]

    fields = T.StructType([T.StructField("lang", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("sure", T.DoubleType(), False)])
    return with_struct(docs, out, fields, made, [text_col])


def identify(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the labelled rows of ``docs`` and add struct column ``out`` (lang, score, sure).

    Labels come from at most DOCS_PER_LANGUAGE rows a language whose id passes `learned_rows`;
    the label, id and source of a row are never inputs of its prediction. Defined cases: rows
    with a null label or id are predicted and not learned from; repeated rows, ties and very long
    texts are predicted whole; an empty table gives no rows; all columns stay.
    """
    return with_language(docs, out, train(samples_of(docs, id_col, text_col, lang_col)), text_col)


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Documents whose text has a language, with windows that are sure to ``least`` or more.

    The windows of a text need not agree: a clean text in several languages stays. Defined cases:
    null, empty and letterless texts go; very long texts are judged by all their windows; repeated
    rows are judged each; null labels and ids are only not learned from; with no label to learn
    from nothing can be judged, and all documents stay; an empty table gives no rows; all columns
    stay as they are.
    """
    model = train(samples_of(docs, "doc_id", "text", "lang"))
    if model is None:
        return docs
    name = free_name(docs, "language")
    found = with_language(docs, name, model)
    return found.where((F.col(f"{name}.lang") != UNDETERMINED) & (F.col(f"{name}.sure") >= least)).drop(name)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, "found").drop("text", "lang")
    held = F.coalesce(~learned_rows(found, "doc_id"), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
