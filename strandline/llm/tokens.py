r"""Token ids of whole texts by a tokenizer file, with tables of words.

The file's pre-tokenizer lower-cases a text, drops white space and cuts the rest into pieces that
its merges never join. So the ids of a text are those of its white-space words one after another,
those of a word are those of its pieces, and can be remembered. New pieces are merged by a second
public engine, `tiktoken`, with the ranks of the file's merges. Both give the same ids as long as
every id's own letters encode to that id alone, which holds for any vocabulary made by merging and
is tested for the file in use.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from .common import runs, slices, utf8
from .winnowing import word_hashes

TABLE_WORDS = 1_000_000  # remembered at most: about 70 MB
SLOT_BITS = 21
POOL_BYTES = 32 << 20  # of the remembered words
CHUNK = 1 << 16  # words looked up at once
SLICE = 250_000  # bytes hashed at once

# the usual range: tab, line ends, printable ASCII and Latin-1 letters and signs; there, lower-casing
# is one to one, NFC changes nothing, and the classes below equal \p{L} and \p{N}
_LETTER = "a-zªµºß-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_END, _BREAK = "\0", "\x01"  # end of a piece, end of a word; the usual range has neither
_PIECE = re.compile(rf"{_BREAK}|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_BREAK}{_LETTER}{_NUMBER}]+")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_USUAL = np.zeros(256, bool)  # bytes of the usual range in UTF-8; 0xC2 needs a second look
_USUAL[[9, 10, 13]] = _USUAL[0x20:0x7F] = _USUAL[0x80:0xC0] = _USUAL[0xC2:0xC4] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class _Words:
    """Word -> ids as an open-addressing table in arrays, asked for many words at once.

    A word is found by a 64-bit hash and then compared byte by byte, so answers are exact. The
    table is emptied before a lookup that could overfill it.
    """

    def __init__(self, make, dtype):
        self.make, self.dtype = make, dtype
        self.clear()

    def clear(self):
        self.keys, self.entry = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.dtype)
        self.byte_ends, self.id_ends = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            more = ~hit & (key != 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _append(self, words: list[bytes]) -> int:
        """Add entries; the number of the first."""
        first = len(self.id_ends) - 1
        ids, counts = self.make(words)
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.ids = np.concatenate([self.ids, ids])
        self.byte_ends = np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum([len(w) for w in words])])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(counts)])
        return first

    def _insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(h):
            first = np.zeros(len(h), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            won = first & (self.keys[slot] == 0)
            self.keys[slot[won]], self.entry[slot[won]] = h[won], entries[won]
            h, entries, slot = h[~won], entries[~won], (slot[~won] + 1) & ((1 << SLOT_BITS) - 1)

    def look_up(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray):
        """(ids of the words one after another, how many each word has)."""
        if len(self.id_ends) + len(h) > TABLE_WORDS or len(self.bytes) > POOL_BYTES:
            self.clear()
        found = self._find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            known, at = np.unique(h[new], return_index=True)
            first = self._append([low[starts[i] : ends[i]].tobytes() for i in new[at].tolist()])
            self._insert(known, np.arange(first, first + len(known), dtype=np.int32))
            found[new] = self._find(h[new])
        sizes = ends - starts
        wrong = np.flatnonzero(self.byte_ends[found + 1] - self.byte_ends[found] != sizes)
        if not len(wrong):
            differ = low[_spread(starts, sizes)] != self.bytes[_spread(self.byte_ends[found], sizes)]
            wrong = np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(differ), side="right")) if differ.any() else wrong
        else:  # two words of one hash and different lengths
            wrong = np.flatnonzero([self.bytes[self.byte_ends[e] : self.byte_ends[e + 1]].tobytes() != low[a:b].tobytes() for e, a, b in zip(found, starts, ends, strict=True)])
        if len(wrong):  # the hash is another word's: entries without a slot
            first = self._append([low[starts[i] : ends[i]].tobytes() for i in wrong.tolist()])
            found[wrong] = np.arange(first, first + len(wrong))
        counts = self.id_ends[found + 1] - self.id_ends[found]
        return self.ids[_spread(self.id_ends[found], counts)], counts


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, size), end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _merger(model: dict):
    """(function from text to ranks, rank -> id). In the text each piece ends with the end mark.

    Ranks: the 256 bytes, then each byte with the end mark, then the merges in order. So the mark
    always joins the last byte first, as the file's end-of-word suffix does.
    """
    import tiktoken

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
    byte_of, suffix, vocab = {c: bytes([b]) for b, c in letter.items()}, model["end_of_word_suffix"], model["vocab"]

    def as_bytes(token: str) -> bytes:
        whole = token.removesuffix(suffix)
        return b"".join(byte_of[c] for c in whole) + (b"\0" if whole != token else b"")

    def merged(pair) -> str:
        first, second = pair if isinstance(pair, list) else pair.split(" ")
        return first + second

    tokens = [*(letter[b] for b in range(256)), *(letter[b] + suffix for b in range(256)), *map(merged, model["merges"])]
    ranks = {as_bytes(t): i for i, t in enumerate(tokens)}
    if len(ranks) != len(tokens):
        raise ValueError("the tokenizer's merges are not one a token")
    engine = tiktoken.Encoding("word-bpe", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
    return engine.encode_ordinary, np.array([vocab[t] for t in tokens])


class WordBpe:
    """Encoder with the ids of the tokenizer file itself.

    Texts outside the usual range, and texts with the file's special strings, go to the tokenizer
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = tuple(t.content.encode() for t in self.whole.get_added_tokens_decoder().values())
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        merge, id_of = _merger(json.loads(Path(path).read_text(encoding="utf-8"))["model"])
        id_of = id_of.astype(self.dtype)
        (break_rank,) = merge(_BREAK + _END)

        def make(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            pieces = _PIECE.findall(b"\x01".join(words).decode() + _BREAK)
            ranks = np.array(merge(_END.join(pieces) + _END), np.int64)
            breaks = ranks == break_rank
            ends = np.flatnonzero(breaks)
            return id_of[ranks[~breaks]], np.diff(ends, prepend=-1) - 1

        self.words = _Words(make, self.dtype)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the n + 1 places where texts begin and end."""
        raw, offsets = utf8(texts)
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for a, b in slices(offsets, SLICE):
            part, counts = self._slice(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(part)
            sizes.append(counts)
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _unusual(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that must go to the tokenizer whole."""
        bad = [np.flatnonzero(~_USUAL[raw])]
        lead = np.flatnonzero(raw[:-1] == 0xC2)
        bad.append(lead[raw[lead + 1] <= 0xA0])
        blob = raw.tobytes()
        for s in self.specials:
            at = blob.find(s)
            while at >= 0:
                bad.append(np.array([at]))
                at = blob.find(s, at + 1)
        return np.unique(np.searchsorted(offsets, np.concatenate(bad), side="right") - 1)

    def _slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unusual = self._unusual(raw, offsets)
        low = _LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        second = raw[lead + 1]
        low[lead[(second <= 0x9E) & (second != 0x97)] + 1] += 0x20  # capital letters of Latin-1
        mask = ~_SPACE[raw]
        for t in unusual.tolist():
            mask[offsets[t] : offsets[t + 1]] = False
        starts, ends, first = runs(mask, offsets)
        h = word_hashes(low, starts, ends) | np.uint64(1)
        parts, counts = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for i in range(0, len(h), CHUNK):
            got, n = self.words.look_up(low, starts[i : i + CHUNK], ends[i : i + CHUNK], h[i : i + CHUNK])
            parts.append(got)
            counts.append(n)
        ids, before = np.concatenate(parts), np.cumsum(np.concatenate(counts))[first]
        if not len(unusual):
            return ids, np.diff(before)
        out = np.split(ids, before[1:-1])
        for t in unusual.tolist():
            text = raw[offsets[t] : offsets[t + 1]].tobytes().decode()
            out[t] = np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)
        return np.concatenate(out), np.array([len(x) for x in out])


_open: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One encoder per Python worker and file."""
    if path not in _open:
        _open[path] = WordBpe(path)
    return _open[path]
