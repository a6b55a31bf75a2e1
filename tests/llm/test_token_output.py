from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import token_output as to

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    slots = to.permute(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert (to.permute(np.arange(n)[::-1], n)[::-1] == slots).all()
    if n > 100:
        assert (slots != to.permute(np.arange(n), n, key=1)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def test_round_trip(spark, odd, odd_rows, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = to.write_shards(odd, path, PATH, length=64, shard_bytes=1 << 12).collect()
    data = to.read_slots(path, 0, 10**9)
    assert data.shape == (len(rows), 64)
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    got = {}
    for r in rows:
        record, at = data[r["slot"]], 0
        assert zlib.crc32(record.tobytes()) == r["record_crc32"]
        assert (record[r["n_tokens"] :] == 1).all()
        for doc, start, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            got.setdefault(doc, []).append((start, record[at : at + n].tolist()))
            at += n
        assert at == r["n_tokens"]
    whole = Tokenizer.from_file(PATH)
    for doc, pieces in got.items():
        texts = [t for i, t, *_ in odd_rows if i == doc]
        ids = whole.encode(texts[0] or "", add_special_tokens=False).ids + [1]
        assert sorted(x for _, p in pieces for x in p) == sorted(ids * len(texts))
        if len(texts) == 1:
            assert [x for _, p in sorted(pieces) for x in p] == ids
    assert set(got) == {r[0] for r in odd_rows}
    # any run of slots reads alone, across shards
    assert (to.read_slots(path, 30, 70) == data[30:100]).all()
    about = json.loads((tmp_path / "shards" / "manifest.json").read_text())
    assert about["shards"] == len(list((tmp_path / "shards").glob("shard-*.bin"))) > 1
    assert all(f.stat().st_size % about["stride"] == 0 for f in (tmp_path / "shards").glob("shard-*.bin"))
    # again: the same bytes
    again = f"file://{tmp_path}/again"
    to.write_shards(odd, again, PATH, length=64, shard_bytes=1 << 12)
    assert (to.read_slots(again, 0, 10**9) == data).all()


def test_slots_and_records_against_brute_force(spark, tmp_path):
    """One partition in a known order: each sequence's slot and bytes, computed plainly."""
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, rng.integers(0, 90)))) for i in range(120)]
    path = f"file://{tmp_path}/shards"
    rows = to.write_shards(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), path, PATH, length=64, shard_bytes=1 << 12).collect()
    whole = Tokenizer.from_file(PATH)
    stream, owner = [], []
    for i, t in docs:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 1]
        stream += ids
        owner += [(i, k) for k in range(len(ids))]
    n = -(-len(stream) // 64)
    slots = to.permute(np.arange(n), n)
    data, by_slot = to.read_slots(path, 0, n), {r["slot"]: r for r in rows}
    assert len(by_slot) == n
    for k in range(n):
        part, r = stream[k * 64 : k * 64 + 64], by_slot[slots[k]]
        assert data[slots[k]].tolist() == part + [1] * (64 - len(part)) and r["n_tokens"] == len(part)
        assert [x for d, s, m in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True) for x in ((d, s + j) for j in range(m))] == owner[k * 64 : k * 64 + 64]


def test_empty(none, tmp_path):
    assert to.write_shards(none, f"file://{tmp_path}/s", PATH).collect() == []
    assert json.loads((tmp_path / "s" / "manifest.json").read_text())["shards"] == 0
