"""Benchmark decontamination by winnowed fingerprints and exact extension of hits."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bytes, free_name, runs, slices, utf8, with_struct

SPAN = 13  # words of a window; every shared span of so many words is found
GRAM = 5  # words of a fingerprint
WINDOW = SPAN - GRAM + 1  # fingerprints of a winnowing window
SHARE = 20  # contaminated if at least one word in SHARE is hit
BLOCK_BYTES = 32 << 20  # text of the benchmark that is broadcast at once; see Index for its size in a worker
REMEMBERED = 10_000  # windows whose items a worker remembers
SLICE = 250_000  # bytes hashed at once

# digits, letters after lower-casing, and all that is not ASCII
_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _INVERSE)]))
        return self.up, self.down


_powers = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(raw: np.ndarray, offsets: np.ndarray):
    """Words of texts laid end to end: lower-cased bytes, starts, ends, first word of each text."""
    low = _LOWER[raw]
    return low, *runs(_WORD[low], offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, from one running sum over the bytes."""
    up, down = _powers.get(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, across text ends too; callers look at valid places only."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * _BASE + words[i : len(words) - n + 1 + i]
    return _mix(out)


def winnow(grams: np.ndarray, first: np.ndarray, n_words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Places of the fingerprints kept: the minima of the windows of each text, all of a tie.

    ``first`` and ``n_words`` give each text's words in the run that ``grams`` was made from.
    """
    if len(grams) < window:
        return np.zeros(0, np.int64)
    low = grams[: len(grams) - window + 1].copy()
    for i in range(1, window):
        np.minimum(low, grams[i : len(grams) - window + 1 + i], out=low)
    valid = np.zeros(len(low), bool)
    per = np.maximum(n_words - gram - window + 2, 0)  # windows of each text
    at = np.repeat(first, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    valid[at] = True
    low[~valid] = 0
    best = np.zeros(len(grams), np.uint64)
    for i in range(window):
        np.maximum(best[i : i + len(low)], low, out=best[i : i + len(low)])
    return np.flatnonzero((best == grams) & (best > 0))


class Index:
    """Windows of benchmark items: winnowed fingerprints, hashes of whole windows and where they are.

    All in arrays: the items' bytes, the ends of words (8 bytes a word), for each window a hash
    and a place (12 bytes), and fingerprints (8 bytes, about two in ten words): four to five times
    the text of usual words, and ten times that of words of one letter.
    """

    def __init__(self, items: list[tuple[object, str]], span: int, gram: int):
        self.span, self.gram, self.window = span, gram, span - gram + 1
        self.names = [name for name, _ in items]
        raw, offsets = utf8(pa.array([text for _, text in items], pa.large_string()))
        lows, starts, ends, firsts, prints, before = [], [], [], [np.zeros(1, np.int64)], [], 0
        windows: dict[int, list] = {}
        for a, b in slices(offsets, SLICE):
            low, begin, end, first = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            hashes, n_words = word_hashes(low, begin, end), np.diff(first)
            for n in np.unique(np.minimum(n_words, span)).tolist():
                if not n:
                    continue
                mine = np.minimum(n_words, span) == n
                per = np.where(mine, n_words - n + 1, 0)
                at = np.repeat(first[:-1], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                windows.setdefault(n, []).append((gram_hashes(hashes, n)[at], (at + before).astype(np.int32)))
            grams = gram_hashes(hashes, gram)
            prints.append(np.unique(grams[winnow(grams, first[:-1], n_words, gram, self.window)]))
            lows.append(low)
            starts.append((begin + offsets[a]).astype(np.int32))
            ends.append((end + offsets[a]).astype(np.int32))
            firsts.append(first[1:] + before)
            before += len(begin)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.low, self.starts, self.ends, self.first = join(lows, np.uint8), join(starts, np.int32), join(ends, np.int32), np.concatenate(firsts)
        self.prints = np.unique(join(prints, np.uint64))
        # by number of words (short items, and the span itself): ascending hashes, places of first words
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, parts in windows.items():
            hashes, places = (np.concatenate(x) for x in zip(*parts, strict=True))
            by = np.argsort(hashes, kind="stable")
            self.at[n] = hashes[by], places[by]
        self.asked: dict[bytes, frozenset] = {}

    def nbytes(self) -> int:
        """Bytes of all arrays."""
        arrays = [self.low, self.starts, self.ends, self.first, self.prints, *(x for pair in self.at.values() for x in pair)]
        return sum(a.nbytes for a in arrays)

    def items_with(self, window: bytes, h: np.uint64, n: int) -> frozenset:
        """Numbers of the items that have this window of ``n`` words, compared word by word."""
        if window not in self.asked:
            if len(self.asked) >= REMEMBERED:
                self.asked.clear()
            hashes, places = self.at[n]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            same = [p for p in places[lo:hi].tolist() if b" ".join([self.low[a:b].tobytes() for a, b in zip(self.starts[p : p + n].tolist(), self.ends[p : p + n].tolist(), strict=True)]) == window]
            self.asked[window] = frozenset((np.searchsorted(self.first, same, side="right") - 1).tolist())
        return self.asked[window]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def scan(index: Index, raw: np.ndarray, offsets: np.ndarray):
    """For each text: words, hit intervals [(first, end)] of word places, and the items found."""
    low, starts, ends, first = words_of(raw, offsets)
    n_words = np.diff(first)
    first = first[:-1]
    hashes = word_hashes(low, starts, ends)
    spans: list[tuple[np.ndarray, np.ndarray, int]] = []
    if len(index.prints):
        grams = gram_hashes(hashes, index.gram)
        kept = winnow(grams, first, n_words, index.gram, index.window)
        hits = kept[_among(grams[kept], index.prints)]
        if len(hits):  # extend: the windows of span words that hold the hit
            tries = np.unique((hits[:, None] - np.arange(index.window)[None, :]).ravel())
            tries = tries[(tries >= 0) & (tries + index.span <= len(hashes))]
            whole = np.zeros(len(tries), np.uint64)
            for i in range(index.span):
                whole = whole * _BASE + hashes[tries + i]
            whole = _mix(whole)
            hit = _among(whole, index.at[index.span][0])
            spans.append((tries[hit], whole[hit], index.span))
    for n, (known, _) in index.at.items():
        if n < index.span:  # items shorter than a window: all runs of their length
            runs_of_n = gram_hashes(hashes, n)
            places = np.flatnonzero(_among(runs_of_n, known))
            spans.append((places, runs_of_n[places], n))
    intervals: dict[int, list] = {}
    found: dict[int, set] = {}
    if spans:
        blob = low.tobytes()
        for places, whole, n in spans:
            docs = np.searchsorted(first, places, side="right") - 1
            inside = places + n <= first[docs] + n_words[docs]
            for p, h, d in zip(places[inside].tolist(), whole[inside], docs[inside].tolist(), strict=True):
                window = b" ".join([blob[a:b] for a, b in zip(starts[p : p + n].tolist(), ends[p : p + n].tolist(), strict=True)])
                items = index.items_with(window, h, n)
                if items:
                    p -= int(first[d])
                    intervals.setdefault(d, []).append((p, p + n))
                    found.setdefault(d, set()).update(items)
    return n_words, intervals, {d: {index.names[i] for i in items} for d, items in found.items()}


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Blocks of at most ``limit`` bytes of items (one item at least), in the order of their ids."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).where("text is not null").distinct()
    block, size = [], 0
    for row in rows.orderBy("item", "text").toLocalIterator():
        block.append((row["item"], row["text"]))
        size += len(row["text"].encode())
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


def mark_contamination(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add struct column ``out``: n_words, hits (merged intervals of word places), items.

    Winnowing with k = ``gram`` and w = span - k + 1: a text keeps the least k-gram hash of each
    window of w, so that two texts that share ``span`` words share a fingerprint. A document's
    fingerprints are joined with the benchmark's by hash; around each hit the windows of ``span``
    words are looked up and compared word by word. Items of fewer words are one window each and
    are looked up at every place. The benchmark goes out in broadcast blocks of bounded size, one
    narrow pass over the documents each: no shuffle, and no row leaves its partition.

    Defined cases: null, empty and wordless texts have no words and no hits, such items no
    windows; items of null id count as an item named null; texts of any length are read whole;
    equal items, copies and repeated rows are judged each; all columns of ``docs`` stay.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    item_type = benchmark.schema[item_col].dataType
    fields = T.StructType([
        T.StructField("n_words", T.LongType(), False),
        T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
        T.StructField("items", T.ArrayType(item_type, True), False),
    ])
    total = None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        sent, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def made(columns, sent=sent, key=key):
            known = _index(key, sent, span, gram)
            raw, offsets = utf8(columns[0])
            n, hits, items = [], [], []
            for a, b in slices(offsets, SLICE):
                words, intervals, found = scan(known, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n += words.tolist()
                for d in range(b - a):
                    hits.append([list(x) for x in merged(intervals.get(d, []))])
                    items.append(list(found.get(d, ())))
            return [pa.array(n, pa.int64()), hits, items]

        name = free_name(docs if total is None else total, out if total is None else f"{out}_more")
        marked = with_struct(docs if total is None else total, name, fields, made, [text_col])
        if total is None:
            total, kept = marked, name
        else:  # a further block: its intervals and items join those so far
            both = F.sort_array(F.concat(F.col(kept).hits, F.col(name).hits))
            start = F.array().cast("array<array<bigint>>")
            union = F.aggregate(both, start, lambda acc, x: F.when((F.size(acc) > 0) & (x[0] <= F.element_at(F.element_at(acc, -1), -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(F.element_at(acc, -1), -1), x[1]))))).otherwise(F.concat(acc, F.array(x))))
            total = marked.withColumn(kept, F.struct(F.col(kept).n_words.alias("n_words"), union.alias("hits"), F.array_union(F.col(kept)["items"], F.col(name)["items"]).alias("items"))).drop(name)
    return total


_indexes: dict = {}


def _index(key: str, items, span: int, gram: int) -> Index:
    """The index of a broadcast block; a Python worker keeps the last one."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(items.value, span, gram)
    return _indexes[key]


def counts(marked, name: str):
    """n_words, n_hit and the contamination rule as columns, from a struct of mark_contamination."""
    n_hit = F.aggregate(F.col(name).hits, F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    n_words = F.col(name).n_words
    return n_words, n_hit, (n_hit > 0) & (SHARE * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with the columns they had.

    Defined cases: null, empty and wordless texts stay, as nothing in them is hit; texts of any
    length are read whole; copies and repeated rows are judged each; an empty benchmark, or one of
    nulls, keeps every document; an empty table gives no rows; clashing columns keep their values.
    """
    name = free_name(docs, "contamination")
    marked = mark_contamination(docs, benchmark, name, text_col)
    return marked.where(~counts(marked, name)[2]).drop(name)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "found")
    n_words, n_hit, bad = counts(marked, "found")
    names = F.sort_array(F.transform(F.col("found")["items"], lambda x: x.cast("string")))
    return marked.select("doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size(F.col("found")["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), bad.alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as (select row_number() over () rid, doc_id, {_WORDS_SQL} w from documents),
i as (select item_id, {_WORDS_SQL} w from benchmark),
iw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') g
  from (select item_id, w, least(len(w), {SPAN}) n, unnest(generate_series(1, len(w) - least(len(w), {SPAN}) + 1)) k from i where len(w) > 0)),
dw as (select rid, n, k, array_to_string(w[k:k + n - 1], ' ') g
  from (select rid, w, n, unnest(generate_series(1, len(w) - n + 1)) k from d cross join (select distinct n from iw) where len(w) >= n)),
hits as (select rid, n, k, item_id from dw join iw using (n, g)),
placed as (select rid, count(distinct p) n_hit from (select rid, unnest(generate_series(k, k + n - 1)) p from (select distinct rid, n, k from hits)) group by rid),
named as (select rid, count(*) n_items, sha256(string_agg(s, ',' order by s)) h from (select distinct rid, item_id::varchar s from hits) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(h, sha256('')) items_sha256,
  coalesce(n_hit, 0) > 0 and {SHARE} * coalesce(n_hit, 0) >= len(w) contaminated
from d left join placed using (rid) left join named using (rid)
"""
