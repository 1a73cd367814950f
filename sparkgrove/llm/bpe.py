"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the encoding has one last token: of the vocabulary's tokens that are suffixes
of the prefix (an automaton lists them) it is the one that can follow the last token of what it leaves.
Two tokens can follow each other if merging their joined symbols gives back the two, which a walk over
the facing edges of their merge trees decides. Back-pointers from the whole word give the exact ids.
The new words of a batch are encoded together, prefix by prefix, in arrays.

Cases of encode_decode: a null text counts as empty and has no tokens; ids stay in Spark, so rows pass
through one by one, repeated or with null ids; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrove.llm.words import LONGEST, PATTERN, Words, odd, pieces, spread

END = "</w>"
_STOP = "\x00"  # stands for END as one symbol
#: Distinct words (of text that isn't Latin-1) and pairs of tokens remembered per worker; emptied when full.
WORDS, PAIRS = 100_000, 300_000


def byte_symbols() -> list[str]:
    """Byte to printable symbol: printable Latin-1 bytes stand for themselves, others follow U+0100."""
    plain = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(plain))
    return [shown[b] for b in range(256)]


class Encoder:
    """Reads a tokenizer file whose model is BPE over byte symbols with a word-end suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = byte_symbols()
        own = lambda t: t[: -len(END)] + _STOP if t.endswith(END) else t
        self.ids = {own(t): i for t, i in model["vocab"].items()}
        self.shown = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            l, k, t = self.ids[own(a)], self.ids[own(b)], self.ids[own(a + b)]
            self.rank[t], self.split[t], self.pair_rank[l, k] = r, (l, k), r
        self.matches = ahocorasick.Automaton()
        self._whole: dict[int, bool] = {}
        for t, i in self.ids.items():
            if t != _STOP and self._stands(i):
                self.matches.add_word(t, (i, len(t)))
        self.matches.make_automaton()
        self._trie()
        self.pattern = word_pattern(spec)
        self.words = regex.compile(split_pattern(spec))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._pairs: dict[tuple[int, int], bool] = {}
        self._word: dict[str, tuple[int, ...]] = {}

    def _spine(self, t: int, side: int) -> list[tuple[int, float, float]]:
        """Pieces at the right (side 1) or left (side 0) edge of t's merge tree: (piece, birth, death)."""
        out, death = [], float("inf")
        while True:
            birth = self.rank.get(t, -1)
            out.append((t, birth, death))
            if birth < 0:
                return out
            t, death = self.split[t][side], birth

    def _crossed(self, a: int, b: int, but: tuple[int, int] | None = None) -> bool:
        """Whether some merge joins a piece of a's right edge with a piece of b's left edge."""
        for x, x_birth, x_death in self._spine(a, 1):
            for y, y_birth, y_death in self._spine(b, 0):
                m = self.pair_rank.get((x, y))
                if m is None or (x, y) == but:
                    continue
                at = max(m, x_birth, y_birth)
                if at < x_death and at <= y_death:  # of equal ranks the left merge comes first
                    return True
        return False

    def _stands(self, t: int) -> bool:
        """Whether t's own text encodes as t."""
        if t not in self._whole:
            if t not in self.split:
                self._whole[t] = True
            else:
                l, r = self.split[t]
                self._whole[t] = self._stands(l) and self._stands(r) and not self._crossed(l, r, but=(l, r))
        return self._whole[t]

    def _trie(self) -> None:
        """The same tokens as a trie in sorted arrays: edges (node, symbol) -> node, and each node's token."""
        number = {c: b for b, c in enumerate(self.symbols)} | {_STOP: 256}
        edges: dict[int, int] = {}
        token = [-1]
        for t, (i, _) in self.matches.items():
            node = 0
            for c in t:
                key = node << 9 | number[c]
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self._edges, self._child = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self._token = np.array(token, np.int64)

    def _all_matches(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every token in the symbols; none crosses a word's end."""
        at, node, k, found = np.arange(len(s)), np.zeros(len(s), np.int64), 0, []
        while len(at):
            key = node << 9 | s[at + k]
            e = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
            ok = self._edges[e] == key
            at, node, k = at[ok], self._child[e[ok]], k + 1
            t = self._token[node]
            hit = t >= 0
            found.append((at[hit], np.full(int(hit.sum()), k), t[hit]))
            on = at + k < len(s)
            at, node = at[on], node[on]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(a << 20 | b, return_inverse=True)
        return np.array([self.can_follow(p >> 20, p & 0xFFFFF) for p in pairs.tolist()], bool)[back]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids laid end to end, number of each word's) of words given as text, by all their prefixes at once."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        n = np.array([len(b) + 1 for b in raw], np.int64)
        s = np.concatenate((np.frombuffer(b"\0".join([*raw, b""]), np.uint8).astype(np.int64), np.empty(0, np.int64)))
        final = np.cumsum(n) - 1
        s[final] = 256
        begin = final - n + 1
        own = np.repeat(begin, n)
        start, size, token = self._all_matches(s)
        end = start + size - own[start]  # the prefix's length
        order = np.lexsort((-size, end))
        start, size, token, end = start[order], size[order], token[order], end[order]
        cuts = np.flatnonzero(np.concatenate(([True], (end[1:] != end[:-1]) | (size[1:] != size[:-1]), [True])))
        last, width = np.full(len(s), -1), np.zeros(len(s), np.int64)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k = int(size[x])
            p = start[x:y] + k - 1
            open_ = last[p] < 0
            a, p, t = start[x:y][open_], p[open_], token[x:y][open_]
            if int(end[x]) > k:
                before = last[a - 1]
                ok = before >= 0
                ok[ok] = self._follow(before[ok], t[ok])
                p, t = p[ok], t[ok]
            last[p], width[p] = t, k
        if len(s) and (last[final] < 0).any():
            raise ValueError(f"no encoding of {words[int(np.flatnonzero(last[final] < 0)[0])]!r}")
        at, who, step, got = final.copy(), np.arange(len(words)), 0, []
        while len(at):
            got.append((who, np.full(len(who), -step), last[at]))
            at, step = at - width[at], step + 1
            on = at >= begin[who]
            at, who = at[on], who[on]
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        who, step, ids = (np.concatenate(x) for x in zip(*got))
        return ids[np.lexsort((step, who))], np.bincount(who, minlength=len(words))

    def can_follow(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = not self._crossed(a, b)
        return known

    def encode_word(self, symbols: str) -> tuple[int, ...]:
        """Ids of one word given as byte symbols."""
        s = symbols + _STOP
        n = len(s)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (t, k) in self.matches.iter(s):
            i = end + 1
            if last[i] >= 0:
                continue
            j = i - k
            if j == 0 or (last[j] >= 0 and self.can_follow(last[j], t)):
                last[i], size[i] = t, k
        out, i = [], n
        while i:
            if last[i] < 0:
                raise ValueError(f"no encoding of {symbols!r}")
            out.append(last[i])
            i -= size[i]
        return tuple(out[::-1])

    def _cached_word(self, w: str) -> tuple[int, ...]:
        got = self._word.get(w)
        if got is None:
            if len(self._word) >= WORDS:
                self._word.clear()
            sym = self.symbols
            got = self._word[w] = self.encode_word("".join([sym[b] for b in w.encode("utf-8", "surrogatepass")]))
        return got

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a stretch of text. Words never span the characters [\\x20\\x09-\\x0D], so a text's ids
        are those of its stretches between them."""
        out: list[int] = []
        for k, part in enumerate(self.specials.split(chunk) if self.specials else [chunk]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                if part.isascii():
                    part = part.lower()
                else:
                    part = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
                for w in self.words_of(part):
                    out.extend(self._cached_word(w))
        return out

    def words_of(self, part: str) -> list[str]:
        if part.isascii():
            return self.words.findall(part)
        # what the interpreter's Unicode tables don't assign is neither letter nor number, whatever newer tables say
        probe = "".join([c if c.isascii() or unicodedata.category(c) != "Cn" else "\uffff" for c in part])
        return [part[m.start() : m.end()] for m in self.words.finditer(probe)]

    def encode(self, text: str | None) -> list[int]:
        return [i for c in (text or "").encode("utf-8", "surrogatepass").split() for i in self.encode_chunk(c.decode("utf-8", "surrogatepass"))]

    def decode(self, ids: list[int]) -> str:
        """The tokens' written forms with blanks between: the file names no decoder."""
        return " ".join(self.shown[i] for i in ids)


def word_pattern(spec: dict) -> str:
    return spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


def split_pattern(spec: dict) -> str:
    """The file's word pattern, with white space by its Unicode property as the library has it."""
    return word_pattern(spec).replace(r"[^\s", r"[^\p{White_Space}")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Digests:
    """Per distinct word: its ids as text and its decoded text, a blank after each token, and its number of ids."""

    def __init__(self, path: str) -> None:
        self.enc = encoder(path)
        ids = [i for i in range(max(self.enc.shown) + 1)]
        self.shown = [_Flat([f"{i} ".encode() for i in ids]), _Flat([f"{self.enc.shown.get(i, '')} ".encode("utf-8", "surrogatepass") for i in ids])]
        self.words = Words(self.learn, self.forget)

    def forget(self) -> None:
        self.counts = np.empty(0, np.int64)
        self.written = [_Flat([]), _Flat([])]

    def learn(self, words: list[str]) -> None:
        short = np.array([len(w) <= LONGEST for w in words])
        flat, sizes = self.enc.encode_words([w for w, s in zip(words, short.tolist()) if s])
        counts = np.empty(len(words), np.int64)
        counts[short] = sizes
        rest = [self.enc.encode(w) for w, s in zip(words, short.tolist()) if not s]
        counts[~short] = list(map(len, rest))
        ids, begin = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        ids[spread(begin[short], sizes)] = flat
        for a, got in zip(begin[~short].tolist(), rest):
            ids[a : a + len(got)] = got
        self.counts = np.concatenate((self.counts, counts))
        for written, shown in zip(self.written, self.shown):
            written.add(*shown.joined(ids, counts))

    def rows(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of each text."""
        out, n, sums = [], 0, None
        for some, goes_on in pieces(texts):
            away = [self.enc.pattern != PATTERN or odd(t) for t in some]
            rows, words = self.words.rows([t for t, o in zip(some, away) if not o])
            tokens = np.concatenate(([0], np.cumsum(self.counts[rows])))
            last = np.cumsum(words)
            parts = iter(zip((tokens[last] - tokens[last - words]).tolist(), *[w.texts(rows, words) for w in self.written]))
            for k, (t, o) in enumerate(zip(some, away)):
                if o:
                    ids = self.enc.encode(t)
                    part = len(ids), *[s.texts(np.array(ids, np.int64), np.array([len(ids)]))[0] for s in self.shown]
                else:
                    part = next(parts)
                sums = sums or [_Sum(), _Sum()]
                n += part[0]
                for s, text in zip(sums, part[1:]):
                    s.add(text)
                if k < len(some) - 1 or not goes_on:
                    out.append((n, *[s.digest() for s in sums]))
                    n, sums = 0, None
        return out


class _Sum:
    """SHA-256 of what is added, without the last blank."""

    def __init__(self) -> None:
        self.sha, self.blank = hashlib.sha256(), False

    def add(self, text: memoryview) -> None:
        if len(text):
            if self.blank:
                self.sha.update(b" ")
            self.sha.update(text[: len(text) - 1])
            self.blank = True

    def digest(self) -> str:
        return self.sha.hexdigest()


class _Flat:
    """Byte strings laid end to end."""

    def __init__(self, parts: list[bytes]) -> None:
        self.bytes, self.ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])

    def add(self, raw: np.ndarray, sizes: np.ndarray) -> None:
        self.bytes, self.ends = np.concatenate((self.bytes, raw)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))

    def joined(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the strings of all rows, bytes of each run of counts rows)."""
        size = self.ends[rows + 1] - self.ends[rows]
        total, last = np.concatenate(([0], np.cumsum(size))), np.cumsum(counts)
        return self.bytes[spread(self.ends[rows], size)], total[last] - total[last - counts]

    def texts(self, rows: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        raw, sizes = self.joined(rows, counts)
        ends, view = np.cumsum(sizes).tolist(), memoryview(raw)
        return [view[a:b] for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=2)
def _digests(path: str) -> _Digests:
    """One table per worker, which outlives its tasks."""
    return _Digests(path)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; a map, no shuffle."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = _digests(path)
        for texts in batches:
            yield pd.DataFrame(seen.rows(texts.tolist()), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col).cast("string")).alias("d")).select("doc_id", "d.*")


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids ARRAY<INT>, decoded STRING: the operator's full output."""

    @F.pandas_udf("ids array<int>, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for texts in batches:
            ids = [enc.encode(t) for t in texts.tolist()]
            yield pd.DataFrame({"ids": ids, "decoded": [enc.decode(i) for i in ids]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(text_col).cast("string")).alias("d")).select("doc_id", "d.*")
