"""Token-id output: one wavelet matrix file per shard.

A shard holds the ids of consecutive documents. Its bits, most significant first, form planes; each plane
stably moves zeros before ones for the next. With a count of ones per block, a plane answers rank and
select, so one compressed file serves token access, counting and locating occurrences.

File: magic, then one zstd frame each for the header (JSON), the document table (ids, lengths) and, per
plane, its ones-per-block counts and its bits in chunks that decompress alone.

Cases of write_tokens: a null text counts as empty and has the end id alone; documents are ordered by
(doc_id, content hash), null ids first, repeated rows each kept; extra columns are ignored; an empty
table writes no file and gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.llm.bpe import byte_symbols, word_pattern
from sparkgrove.llm.words import LONGEST, PATTERN, Words, odd, pieces, spread
from sparkgrove.session import materialise, shared_dir

MAGIC = b"WVMX0001"
BLOCK = 512  # bits that one rank count covers
CHUNK = 1 << 16  # bytes of bits that decompress together
#: Tokens after which a task closes its file and opens the next.
SHARD_TOKENS = 4_000_000


# files -------------------------------------------------------------------------------------------


def _local(path: str) -> str | None:
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def put(path: str, data: bytes) -> None:
    """Write whole or not at all: a task that is run again replaces the file."""
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    part = f"{name}.{uuid.uuid4().hex}"
    store.create_dir(os.path.dirname(name), recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def get(path: str) -> bytes:
    if (local := _local(path)) is not None:
        with open(local, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return f.read()


# format ------------------------------------------------------------------------------------------


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard."""
    z = zstandard.ZstdCompressor(level=1)
    top = int(ids.max()) if len(ids) else 0
    bits = max(1, top.bit_length())
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    parts, planes = [], []

    def add(raw: bytes) -> int:
        parts.append(z.compress(raw))
        return len(parts[-1])

    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = [add(np.packbits(known).tobytes()), add(np.array([d or 0 for d in doc_ids], np.int64).tobytes()), add(np.asarray(lengths, np.int64).tobytes())]
    for k in range(bits - 1, -1, -1):
        b = (cur >> cur.dtype.type(k)) & cur.dtype.type(1)
        b = b.view(np.uint8)[:: cur.dtype.itemsize].astype(bool)
        packed = np.packbits(b, bitorder="little")
        whole = np.zeros(-(-len(b) // BLOCK) * (BLOCK // 8), np.uint8)
        whole[: len(packed)] = packed
        ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        chunks = [add(whole[a : a + CHUNK].tobytes()) for a in range(0, len(whole), CHUNK)]
        planes.append({"zeros": int(len(b) - np.count_nonzero(b)), "chunks": chunks, "ones": add(ones.tobytes())})
        cur = np.concatenate((cur[~b], cur[b]))
    head = z.compress(json.dumps({"n": len(ids), "bits": bits, "wide": bits > 16, "n_docs": len(doc_ids), "docs": docs, "planes": planes}).encode())
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class Shard:
    """Reads one file. Positions count from 0; ranges are half open."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        (k,) = struct.unpack("<I", data[8:12])
        self._z = zstandard.ZstdDecompressor()
        head = json.loads(self._z.decompress(data[12 : 12 + k]))
        self.n, self.bits, self.wide, self.n_docs = head["n"], head["bits"], head["wide"], head["n_docs"]
        at = 12 + k
        self._data, table = data, []
        for size in head["docs"]:
            table.append(self._z.decompress(data[at : at + size]))
            at += size
        known = np.unpackbits(np.frombuffer(table[0], np.uint8))[: self.n_docs].astype(bool)
        ids = np.frombuffer(table[1], np.int64)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(ids, known)]
        self.lengths = np.frombuffer(table[2], np.int64)
        self.planes = []
        for p in head["planes"]:
            where = []
            for size in p["chunks"]:
                where.append((at, size))
                at += size
            ones = np.frombuffer(self._z.decompress(data[at : at + p["ones"]]), np.uint32)
            at += p["ones"]
            self.planes.append((p["zeros"], where, np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))))
        self._chunk = functools.lru_cache(maxsize=64)(self._read_chunk)

    def _read_chunk(self, k: int, c: int) -> bytes:
        at, size = self.planes[k][1][c]
        return self._z.decompress(self._data[at : at + size])

    def _rank1(self, k: int, i: int) -> int:
        """Ones of plane k before position i."""
        block, rest = divmod(i, BLOCK)
        count = int(self.planes[k][2][block])
        if rest:
            byte = block * (BLOCK // 8)
            c, at = divmod(byte, CHUNK)
            bits = int.from_bytes(self._chunk(k, c)[at : at + BLOCK // 8], "little")
            count += (bits & ((1 << rest) - 1)).bit_count()
        return count

    def _bit(self, k: int, i: int) -> int:
        c, at = divmod(i >> 3, CHUNK)
        return self._chunk(k, c)[at] >> (i & 7) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for k in range(self.bits):
            b = self._bit(k, i)
            ones = self._rank1(k, i)
            i = self.planes[k][0] + ones if b else i - ones
            v = v << 1 | b
        return v

    def _descend(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            zeros = self.planes[k][0]
            lo, hi = (zeros + a, zeros + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token at positions lo to hi."""
        if token >> self.bits:
            return 0
        lo, hi = self._descend(token, lo, self.n if hi is None else hi)
        return hi - lo

    def _select(self, k: int, bit: int, r: int) -> int:
        """Position of the r-th (from 0) such bit of plane k, by bisection over ranks."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            ones = self._rank1(k, mid)
            lo, hi = (mid, hi) if (ones if bit else mid - ones) <= r else (lo, mid)
        return lo

    def locate(self, token: int, r: int) -> int:
        """Position of the r-th (from 0) occurrence of token."""
        if token >> self.bits or not 0 <= r < self.count(token):
            raise IndexError(r)
        i = self._descend(token, 0, self.n)[0] + r
        for k in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - k) & 1
            i = self._select(k, bit, i - self.planes[k][0] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids, planes undone from the last to the first."""
        kind = np.uint32 if self.wide else np.uint16
        low = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            zeros, where, _ = self.planes[k]
            raw = np.frombuffer(b"".join([self._z.decompress(self._data[a : a + s]) for a, s in where]), np.uint8)
            b = np.unpackbits(raw, count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~b] = low[:zeros]
            up[b] = low[zeros:] | kind(1 << (self.bits - 1 - k))
            low = up
        return low


# operator ----------------------------------------------------------------------------------------


class _Ids:
    """Ids of whole texts: each distinct word of Latin-1 text by the library's model, other text by the
    whole library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.known = word_pattern(json.load(f)) == PATTERN
        self.symbols = byte_symbols()
        self.words = Words(self.learn, self.forget)

    def forget(self) -> None:
        self.flat, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        sym, model = self.symbols, self.library.model.tokenize
        shown = lambda w: w if w.isascii() and w.isprintable() else "".join([sym[b] for b in w.encode()])
        # the model's time grows with the square of a word's length; the library's does not
        got = [[t.id for t in model(shown(w))] if len(w) <= LONGEST else self.library.encode(w, add_special_tokens=False).ids for w in words]
        self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(got), np.uint32)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(list(map(len, got)))))

    def _of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts and their lengths."""
        away = [k for k, t in enumerate(texts) if not self.known or odd(t)]
        plain = np.ones(len(texts), bool)
        plain[away] = False
        rows, words = self.words.rows(list(itertools.compress(texts, plain)))
        size = self.ends[rows + 1] - self.ends[rows]
        total, last = np.concatenate(([0], np.cumsum(size))), np.cumsum(words)
        got = [e.ids for e in self.library.encode_batch_fast([texts[k] for k in away], add_special_tokens=False)] if away else []
        lengths = np.empty(len(texts), np.int64)
        lengths[plain], lengths[away] = total[last] - total[last - words], list(map(len, got))
        out = np.empty(int(lengths.sum()), np.uint32)
        begin = np.cumsum(lengths) - lengths
        out[spread(begin[plain], lengths[plain])] = self.flat[spread(self.ends[rows], size)]
        for k, ids in zip(away, got):
            out[begin[k] : begin[k] + len(ids)] = ids
        return out, lengths

    def ids(self, texts: list[str | None], end: int):
        """(ids of some whole texts, each followed by the end id; their lengths), in order."""
        begun = np.empty(0, np.uint32)
        for some, goes_on in pieces(texts):
            flat, lengths = self._of(some)
            flat, lengths[0] = np.concatenate((begun, flat)), lengths[0] + len(begun)
            cut = len(flat) - (int(lengths[-1]) if goes_on else 0)
            begun, flat, lengths = flat[cut:], flat[:cut], lengths[: len(lengths) - goes_on]
            if not len(lengths):
                continue
            out = np.full(len(flat) + len(lengths), end, np.uint32)
            out[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = flat
            yield out, lengths + 1


@functools.lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    """One table per worker, which outlives its tasks."""
    return _Ids(path)


def write_tokens(docs: DataFrame, path: str, out: str | None = None, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shard files and return their manifest: part, seq, file, n_docs, n_tokens, start.

    One shuffle: a range exchange on the id. Tasks stream: a file is closed after shard_tokens tokens.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # a nullable id would pass through pandas as a float
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = d.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")).select("id", "none", "text")

    def write(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode, names, held, sizes, size = _ids(path).ids, [], [], [], 0

        def close():
            nonlocal seq, names, held, sizes, size
            file = f"{out}/part-{part:06d}-{seq:05d}.wvm"
            put(file, pack(np.concatenate(held), names, np.concatenate(sizes)))
            row = (part, seq, file, len(names), size)
            seq, names, held, sizes, size = seq + 1, [], [], [], 0
            return pd.DataFrame([row], columns=["part", "seq", "file", "n_docs", "n_tokens"])

        for pdf in batches:
            ids = [None if none else d for d, none in zip(pdf["id"].tolist(), pdf["none"].tolist())]
            at = 0
            for tokens, lengths in encode(pdf["text"].tolist(), end_id):
                names += ids[at : at + len(lengths)]
                at += len(lengths)
                held.append(tokens), sizes.append(lengths)
                size += len(tokens)
                if size >= shard_tokens:
                    yield close()
        if names:
            yield close()

    manifest = materialise(placed.mapInPandas(write, "part int, seq int, file string, n_docs long, n_tokens long"), "manifest")
    # one row a file: small; offsets of files need their order
    before = F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches):
        for pdf in batches:
            for file, start in zip(pdf["file"], pdf["start"]):
                shard = Shard(get(file))
                ids = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                yield pd.DataFrame({"doc_id": pd.array(shard.doc_ids, "Int64"), "start": begins + start, "n_tokens": shard.lengths, "ids_crc32": np.array(crc, np.int64)})

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = manifest.select("file", "start").repartition(n, "file")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str, end_id: int = 1, **names) -> DataFrame:
    """Encode, write, read back."""
    return read_tokens(write_tokens(docs, path, end_id=end_id, **names))
