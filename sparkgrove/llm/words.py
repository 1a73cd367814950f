"""Texts of Latin-1 letters as rows of a table of distinct words, each encoded once; in numpy.

Such text is normal as it is: lower case and the tokenizer file's word pattern are all that precede its
model. Other text, text that may hold added tokens, and files with another pattern are left to the caller.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

#: The word pattern that bounds() implements.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words and bytes of words that a table holds before it starts anew.
LIMIT, BYTES = 300_000, 8_000_000
#: Characters looked up together.
SLICE = 500_000
#: Words up to this length are encoded together.
LONGEST = 64
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.array([_SPACE if chr(c) in "\t\n\x0b\x0c\r \x85\xa0" else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(256)], np.uint8)
_RNG = np.random.default_rng(64)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def odd(text: str) -> bool:
    """Whether a text holds letters that normalising may change, or what may be an added token."""
    if "<|" in text:
        return True
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def pieces(texts: list[str | None]):
    """(texts of about SLICE characters in all, whether the last goes on in the next list), in order: long
    texts are cut at blanks, which no word spans."""
    held, size = [], 0
    for t in texts:
        at, t = 0, t or ""
        while len(t) - at > SLICE and (cut := t.find(" ", at + SLICE)) >= 0:
            yield [*held, t[at:cut]], True
            held, size, at = [], 0, cut
        held.append(t[at:])
        size += len(t) - at
        if size >= SLICE:
            yield held, False
            held, size = [], 0
    if held:
        yield held, False


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes of ranges laid end to end."""
    return np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, whether a byte lies in a word) of the words of lower-cased Latin-1 text that ends in blanks."""
    kind = _KIND[b]
    new = np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == _NUMBER)
    q = np.flatnonzero(new & (b == ord("'")))
    one, two = b[q + 1], b[q + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    new[q[short | long] + 1] = False
    new[q[short] + 2] = True
    new[q[long] + 3] = True
    word = kind != _SPACE
    return np.flatnonzero(new & word), word


class Words:
    """learn(words, in the order of their rows) is called with new ones; forget() when the table starts anew."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None]) -> None:
        self.learn, self.forget = learn, forget
        self._clear()

    def _clear(self) -> None:
        self.keys, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.bytes, self.ends = np.empty(0, np.uint8), np.zeros(1, np.int64)
        self.forget()

    def __len__(self) -> int:
        return len(self.row)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of all words, number of each text's). They hold until the next call."""
        global _powers
        if len(self.row) >= LIMIT or len(self.bytes) >= BYTES:
            self._clear()
        b = np.frombuffer("".join([t.lower() + "   " for t in texts]).encode("latin-1"), np.uint8)
        starts, word = bounds(b)
        first = np.cumsum([0, *[len(t) + 3 for t in texts]])
        counts = np.diff(np.searchsorted(starts, first))
        if not len(starts):
            return np.empty(0, np.int64), counts
        ends = np.append(starts[1:], len(b))
        inside = np.concatenate(([0], np.cumsum(word)))
        size = inside[ends] - inside[starts]
        own = b[word]
        begin = np.cumsum(size) - size
        place = np.arange(len(own)) - np.repeat(begin, size)
        if (top := int(size.max())) > len(_powers):
            _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * top, 0x9E3779B97F4A7C15, np.uint64))))
        keys = np.add.reduceat(_BYTE[own] * _powers[place], begin)
        keys ^= keys >> np.uint64(29)
        distinct, back = np.unique(keys, return_inverse=True)
        some = np.empty(len(distinct), np.int64)
        some[back] = np.arange(len(back))
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inner = at < len(self.keys)
        known[inner] = self.keys[at[inner]] == distinct[inner]
        row = np.empty(len(distinct), np.int64)
        row[known] = self.row[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            row[fresh] = len(self.row) + np.arange(len(fresh))
            self.keys = np.insert(self.keys, at[fresh], distinct[fresh])
            self.row = np.insert(self.row, at[fresh], row[fresh])
            n, where = size[some[fresh]], begin[some[fresh]]
            self.bytes = np.concatenate((self.bytes, own[spread(where, n)]))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(n)))
            whole = own.tobytes().decode("latin-1")
            self.learn([whole[x : x + k] for x, k in zip(where.tolist(), n.tolist())])
        out = row[back]
        # keys are hashes: hold every word against the bytes its row stands for
        length = self.ends[out + 1] - self.ends[out]
        if (length != size).any() or (self.bytes[spread(self.ends[out], size)] != own).any():
            raise ArithmeticError("two words share a 64-bit hash")
        return out, counts
