from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as tx


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i long, t string")
    return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def model_tokens(text):
    """Character by character: runs of letters and digits, cut at a capital after another kind,
    and where digits meet letters."""
    out, run = [], ""

    def ends():
        if not run:
            return
        pieces, start = [], 0
        for i in range(1, len(run)):
            up = lambda c: unicodedata.category(c) == "Lu"
            digit = lambda c: unicodedata.category(c) == "Nd"
            if (up(run[i]) and not up(run[i - 1])) or digit(run[i]) != digit(run[i - 1]):
                pieces.append(run[start:i])
                start = i
        pieces.append(run[start:])
        out.extend(p.lower() for p in pieces)
        if len(pieces) > 1:
            out.append(run.lower())

    for c in text:
        if ord(c) <= 0xFFFF and (unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"):
            run += c
        else:
            ends()
            run = ""
    ends()
    return out


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("hello", ["hello"]), ("foo-bar baz", ["foo", "bar", "baz"]), ("  spaced   out ", ["spaced", "out"]),
        ("ValidateOnStart", ["validate", "on", "start", "validateonstart"]), ("abc123", ["abc", "123", "abc123"]),
        ("", []), ("--- *** ---", []), ("HTTPServer", ["httpserver"]), ("a\U0001d400b", ["a", "b"]),
    ],
)
def test_golden_tokens(spark, text, tokens):
    assert column(spark, [text], tx.token_array) == [tokens]


def test_tokens_agree_with_a_character_model(spark):
    rng = random.Random(3)
    alphabet = "aBcD19 _-éÉçñÑßǅʰ中文٣\U0001f600\U0001d400.\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(400)]
    assert column(spark, texts, tx.token_array) == [model_tokens(t) for t in texts]


def test_null_has_no_tokens(spark):
    assert column(spark, [None, "a"], tx.token_array) == [[], ["a"]]


def test_folding_is_letter_by_letter(spark):
    assert column(spark, ["ΟΔΟΣ İstanbul"], tx.token_array)[0][0] == "οδοσ"


def model_passages(text):
    lines = re.split(r"\r\n|\r|\n", text)
    if lines[-1] == "":
        lines.pop()
    out, start, chars = [], 0, 0
    for i, line in enumerate(lines, 1):
        if not start and not line.strip():
            continue
        start = start or i
        chars += len(line.encode("utf-16-le")) // 2 + 1
        if (not line.strip() and chars >= 600) or chars >= 1200:
            out.append((start, i))
            start, chars = 0, 0
    if start:
        out.append((start, len(lines)))
    kept = [(a, b, "\n".join(lines[a - 1 : b]).strip()) for a, b in out]
    return [p for p in kept if p[2]]


def test_passages_agree_with_a_line_model(spark):
    rng = random.Random(5)
    lines = ["", "   ", "\t", "word " * 20, "x" * 130, "é" * 60, "\U0001f600" * 70, "y" * 1300, "short"]
    ends = ["\n", "\r\n", "\r"]
    texts = ["".join(rng.choice(lines) + rng.choice(ends) for _ in range(rng.randrange(0, 40))) + rng.choice(["", "tail"]) for _ in range(150)]
    texts += ["", "\n\n", "x" * 1300, "a\n" * 3 + "\n\n\n"]
    got = column(spark, texts, tx.passage_array)
    assert [[(p["start"], p["end"], p["text"]) for p in ps] for ps in got] == [model_passages(t) for t in texts]


def test_paths(spark):
    assert column(spark, ["a/b.cs:1-9", "a:b:c", ":x", "plain", ""], tx.location_path) == ["a/b.cs", "a:b", ":x", "plain", ""]
    assert column(spark, ["src/a.b/c.md:3-4"], lambda c: tx.path_text(F.lit("file"), c, F.lit("t"))) == ["src a b c md"]
    assert column(spark, ["abc123"], lambda c: tx.path_text(F.lit("git"), c, F.lit("Fix it  (me, 2024)"))) == ["Fix it  (me, 2024)"]
    assert column(spark, ["/r/x/a.md", "\\r\\x\\b.md", "/other/c.md"], lambda c: tx.relative_path(c, "/r/x/")) == ["a.md", "b.md", "/other/c.md"]


def test_snippet_line_and_label(spark):
    assert column(spark, ["  abc  ", "abcdef", "a\r\nb"], lambda c: tx.snippet(c, 5)) == ["abc", "abcd…", "a b"]
    assert column(spark, [" a\r\nb c\u0085d "], tx.one_line) == ["a b c d"]
    assert column(spark, ["__label__en", "fr"], tx.strip_label) == ["en", "fr"]
    assert [tx.clamp(x, 50, 200) for x in (10, 60, 999)] == [50, 60, 200]
