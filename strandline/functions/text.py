"""Text functions as column expressions: tokens, passages, paths, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# letters and digits of the basic plane; a letter beyond it separates, as do all other characters
_BASIC = r"&&[\x{0}-\x{FFFF}]]"
_LETTER, _DIGIT, _CAPITAL, _SMALL = rf"[\p{{L}}{_BASIC}", rf"[\p{{Nd}}{_BASIC}", rf"[\p{{Lu}}{_BASIC}", rf"[\p{{L}}&&[^\p{{Lu}}]{_BASIC}"
GAP = r"[[^\p{L}\p{Nd}]\x{10000}-\x{10FFFF}]+"
# the last character of a piece that another piece follows: a run is cut before a capital after something else,
# and between digits and letters
SEAM = rf"{_SMALL}(?=[\p{{Lu}}\p{{Nd}}{_BASIC})|{_CAPITAL}(?={_DIGIT})|{_DIGIT}(?={_LETTER})"
# the same as a test, which looks closer at capitals and digits only
HAS_SEAM = rf"(?=[\p{{Lu}}\p{{Nd}}])(?:(?<={_SMALL})[\p{{Lu}}\p{{Nd}}{_BASIC}|(?<={_DIGIT}){_CAPITAL}|(?<={_CAPITAL}){_DIGIT}|{_DIGIT}(?={_LETTER}))"
MARK = "\x01"  # between the pieces of a run; it is a separator where a text has it
LINE_END = r"\r\n|\r|\n"
ANY_LINE_END = r"\r\n|[\n\r\f\x{85}\x{2028}\x{2029}]"
BLANK = r"(?U)^\s*$"
# fixed values: a passage ends at a blank line from so many characters on, and at the latest at so many
SOFT_CHARS, HARD_CHARS = 600, 1200


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_case(c: Column) -> Column:
    """Lower case letter by letter: no final sigma, and a dotted capital I gives one letter."""
    for capital, small in zip("ΣİẞI", "σißi", strict=True):
        c = F.replace(c, F.lit(capital), F.lit(small))
    return F.lower(c)


def token_array(text: Column | str) -> Column:
    """Lower-cased tokens: the pieces of each run, and the whole run after them if there are several.

    Most texts have no run of several pieces: they are folded and cut at the gaps, with no work a
    token. In the others the pieces are marked first.
    """
    text = F.coalesce(as_column(text), F.lit(""))
    # folded when the gaps are spaces: case may be known of letters that the expressions do not know
    cut = lambda c, gap: F.array_remove(F.split(fold_case(F.regexp_replace(c, F.lit(gap), F.lit(" "))), " ", -1), "")

    def tokens(run: Column) -> Column:
        several = F.concat(F.split(run, MARK, -1), F.array(F.replace(run, F.lit(MARK), F.lit(""))))
        return F.when(F.contains(run, F.lit(MARK)), several).otherwise(F.array(run))

    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(" ")), F.lit(SEAM), F.lit("$0" + MARK))
    pieces = F.flatten(F.transform(cut(marked, GAP.replace(r"\p{Nd}]", r"\p{Nd}\x{1}]")), tokens))
    return F.when(text.rlike(HAS_SEAM), pieces).otherwise(cut(text, GAP))


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def utf16_length(c: Column) -> Column:
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def line_array(text: Column | str) -> Column:
    """Lines at CRLF, CR or LF; a last line end does not begin another line."""
    lines = F.split(F.coalesce(as_column(text), F.lit("")), LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def passage_array(text: Column | str) -> Column:
    """Array of (start, end, text): passages of a text with their 1-based lines.

    Leading blank lines are skipped; a line that is blank with SOFT_CHARS gathered, or any with
    HARD_CHARS, ends the passage; the rest ends with the text. Passages of white space are
    dropped. A line is never cut.
    """
    lines = line_array(text)
    spans = "array<struct<start:int,end:int>>"
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).cast("long").alias("chars"), F.array().cast(spans).alias("spans"))

    def step(acc: Column, line: Column) -> Column:
        i = acc["i"] + 1
        blank = line.rlike(BLANK)
        skip = (acc["start"] == 0) & blank
        start = F.when(skip, F.lit(0)).when(acc["start"] == 0, i).otherwise(acc["start"])
        chars = F.when(skip, F.lit(0).cast("long")).otherwise(acc["chars"] + utf16_length(line) + 1)
        cut = ~skip & ((blank & (chars >= SOFT_CHARS)) | (chars >= HARD_CHARS))
        span = F.struct(start.alias("start"), i.alias("end"))
        return F.struct(
            i.alias("i"), F.when(cut, F.lit(0)).otherwise(start).alias("start"), F.when(cut, F.lit(0).cast("long")).otherwise(chars).alias("chars"),
            F.when(cut, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    def finish(acc: Column) -> Column:
        rest = F.array(F.struct(acc["start"].alias("start"), acc["i"].alias("end")))
        return F.when(acc["start"] > 0, F.concat(acc["spans"], rest)).otherwise(acc["spans"])

    found = F.aggregate(lines, begin, step, finish)
    whole = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), trimmed(F.array_join(F.slice(lines, s["start"], s["end"] - s["start"] + 1), "\n")).alias("text")))
    return F.filter(whole, lambda p: p["text"] != "")


def one_line(text: Column | str) -> Column:
    """Every line end replaced by a space, then trimmed; the form that language models see."""
    return trimmed(F.regexp_replace(as_column(text), ANY_LINE_END, " "))


def strip_label(label: Column | str) -> Column:
    """A model's label without its __label__ prefix."""
    return F.regexp_replace(as_column(label), "^__label__", "")


def body_text(title: Column | str = "title", text: Column | str = "text") -> Column:
    return F.concat(as_column(title), F.lit(" "), as_column(text))


def body_tokens(title: Column | str = "title", text: Column | str = "text") -> Column:
    """The tokens of `body_text`. A title such as a file's name has runs of several pieces, most texts have none."""
    none = F.array().cast("array<string>")
    return F.when(body_text(title, text).isNull(), none).otherwise(F.concat(token_array(title), token_array(text)))


def location_path(location: Column | str) -> Column:
    """What precedes the last colon, if that leaves anything; else all."""
    return F.regexp_replace(as_column(location), r"(?s)^(.+):[^:]*$", "$1")


def path_text(source: Column | str = "source", location: Column | str = "location", title: Column | str = "title") -> Column:
    """The words of a file's path; for other sources the title."""
    return F.when(as_column(source) == "file", F.translate(location_path(location), "/.", "  ")).otherwise(as_column(title))


def relative_path(path: Column | str, root: str) -> Column:
    """``path`` below ``root``, with forward slashes."""
    slashed = F.replace(as_column(path), F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(base)), F.substring(slashed, F.lit(len(base) + 1), F.length(slashed))).otherwise(slashed)


def snippet(text: Column | str, most: int) -> Column:
    """Trimmed, on one line; beyond ``most`` characters cut, with an ellipsis as the last."""
    t = trimmed(F.regexp_replace(as_column(text), LINE_END, " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


def shard_of(key: Column | str, shards: int) -> Column:
    return F.pmod(F.xxhash64(as_column(key)), F.lit(shards)).cast("int")
