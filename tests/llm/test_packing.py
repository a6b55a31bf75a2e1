from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm.packing import fill, pack, step_groups
from strandline.llm.tokens import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(whole):
    rng = random.Random(2)
    alphabet = list("abcdefXYZ012 '.,!-_\n\t\r") + ["'s", "'re", "don't", "é", "ß", "Ñ", "µ", "²", "¼", "×", "÷", "«", " ", "\u0085", "\x1c", "中", "İ", "Σ", "é", "\U0001f600", "<|endoftext|>", " the ", "­"]
    ours = WordBpe(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        assert ours.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_id_encodes_to_itself():
    """What makes the two merge engines agree: merging an id's own letters gives that id alone."""
    import json

    model = json.load(open(PATH))["model"]
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    for token in model["vocab"]:
        if token.startswith("<|"):
            continue
        whole = token.removesuffix("</w>")
        parts = list(whole[:-1]) + [whole[-1] + token[len(whole) :]]
        while len(parts) > 1:
            rank, at = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            assert rank < 1 << 30, token
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [token]


def test_words_of_one_hash_and_full_tables(whole, monkeypatch):
    import pyarrow as pa

    from strandline.llm import tokens

    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcé1.") for _ in range(rng.randrange(1, 9))) for _ in range(300)) for _ in range(8)]
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]

    def check():
        ours = WordBpe(PATH)
        for _ in range(2):
            ids, bounds = ours.encode_all(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected

    check()
    hashes = tokens.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda low, starts, ends: hashes(low, starts, ends) % np.uint64(50))
    check()
    monkeypatch.setattr(tokens, "word_hashes", hashes)
    monkeypatch.setattr(tokens, "TABLE_WORDS", 400)
    monkeypatch.setattr(tokens, "CHUNK", 128)
    monkeypatch.setattr(tokens, "SLICE", 500)
    check()


def test_fill_covers_every_id_once():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.choice([1, 5, rng.randrange(1, 64), rng.randrange(1, 40)]) for _ in range(rng.randrange(0, 50))]
        pieces = [(n, d, 0) for d, n in enumerate(lengths)]
        full, left = fill(pieces, (4, 8, 16), rng.random() < 0.5)
        seen = defaultdict(set)
        for s in [*full, left]:
            for n, d, start in s:
                for x in range(start, start + n):
                    assert x not in seen[d]
                    seen[d].add(x)
        assert all(len(seen[d]) == n for d, n in enumerate(lengths))
        assert all(sum(p[0] for p in s) in (1, 2, 4, 8, 16) for s in full)


def test_fill_last_leaves_nothing_and_keeps_whole_documents_together():
    full, left = fill([(10, 0, 0), (6, 1, 0), (16, 2, 0)], (4, 8, 16), True)
    assert not left
    assert sorted(map(sorted, full)) == [[(6, 1, 0), (10, 0, 0)], [(16, 2, 0)]]


def test_step_groups_are_even():
    lengths = [2048] * 90 + [1024] * 31 + [256] * 57
    groups = step_groups(lengths, 16_384)
    sums = np.bincount(groups, weights=lengths)
    assert sums.max() - sums.min() <= 2048


def check(rows, docs, whole):
    pieces, sequences, counts = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in rows:
        pieces[(r["doc_id"], r["doc_row"], r["sequence_id"] >> 32)].append(r)
        sequences[r["sequence_id"]].append(r)
    expected = defaultdict(int)
    for i, t in docs:
        expected[(i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1]))] += 1
    for (doc_id, _, _), rs in pieces.items():
        rs.sort(key=lambda r: r["start"])
        ids = [x for r in rs for x in np.frombuffer(r["ids"], "<u4").tolist()]
        assert [r["start"] for r in rs] == np.cumsum([0] + [r["length"] for r in rs[:-1]]).tolist()
        assert all(r["doc_tokens"] == len(ids) for r in rs)
        counts[(doc_id, tuple(ids))] += 1
    assert counts == expected
    for rs in sequences.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == np.cumsum([0] + [r["length"] for r in rs[:-1]]).tolist()
        used = sum(r["length"] for r in rs)
        assert used <= 2048
        assert used & (used - 1) == 0


def test_pack(spark, odd, odd_rows, whole):
    check(pack(odd, PATH).collect(), [(r[0], r[1]) for r in odd_rows], whole)


def test_pack_in_small_blocks(spark, whole):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([1, 10, 300, 3000])))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as length")
    check(pack(df, PATH, block_tokens=5000).collect(), docs, whole)


def test_empty(none):
    assert pack(none, PATH).collect() == []
