"""Substring dedup by fingerprints of min-hash anchors, in place of distributed prefix doubling.

A byte is removed when a LENGTH-byte string over it also starts in a document with a smaller id. There is
no suffix array and no round of (position, rank) pairs: positions that the text itself selects are grouped by
hash, and doubling is only how a hash is computed inside one document:

1. Names of 1, 2, 4, 8, 16 and 20 bytes are formed by doubling inside each document (the name of 2h bytes
   at p pairs the names of h bytes at p and p + h). A position is an anchor if its 20-byte name is the
   least of some LENGTH-byte string: equal strings have equal anchors at equal offsets, and about one
   position in sixteen is one.
2. (name, position) pairs of all documents are dealt by name and sorted; names that one document alone
   has are unique and drop out. Most do.
3. The others are extended on both sides to every LENGTH-byte string that holds them, named by doubling on
   to 40 and 50 bytes, dealt and sorted again: a string that starts in a smaller document is marked. Anchors
   of a batch with equal bytes around them travel as one context with their places, and are named once.
4. Marks go back to their documents, whose bytes are cut.

Pairs travel as packed arrays, one row per (batch, bucket). The documents are exchanged once and that
exchange is reused by each step. Whole copies of a document are settled first by content hash, so a text
that a third of all rows share enters the sort once.

Cases: a null text counts as empty; documents under LENGTH bytes lose nothing; rows that repeat id and
text are each judged alike and never remove each other; null ids count as larger than all others and not
as smaller than each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrove.llm.shingles import mix
from sparkgrove.session import materialise

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1  # grams in a string
#: Bytes of text named at once, and buckets per shuffle partition.
SLICE = 1 << 20
FAN = 2
#: Texts that at least this share of all rows hold whole are joined by broadcast: there are at most 1 / HOT.
HOT = 0.001
_NO_ID = np.iinfo(np.int64).max
_RNG = np.random.default_rng(50)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _double(h: np.ndarray, by: int) -> np.ndarray:
    """Names of strings that overlap or touch: the name at p paired with the one at p + by (last axis)."""
    a = h[..., : h.shape[-1] - by] * _A
    a ^= a >> np.uint64(32)
    a += h[..., by:] * _B
    a ^= a >> np.uint64(29)
    return a


def gram_names(b: np.ndarray) -> np.ndarray:
    h = _BYTE[b]
    for by in (1, 2, 4, 8):
        h = _double(h, by)
    return mix(_double(h, GRAM - 16))


def string_names(grams: np.ndarray) -> np.ndarray:
    """Names of LENGTH-byte strings from those of GRAM bytes: on to 40, then to 50."""
    return _double(_double(grams, 20), LENGTH - 40)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = op(x[: len(x) - k], x[k:])
        k *= 2
    return op(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


#: Strings of a document whose anchors are looked for at once.
PIECE = 1 << 18


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the grams that are least in some string of a document's bytes."""
    found = [_anchors(b[a : a + PIECE + LENGTH - 1], a) for a in range(0, len(b) - LENGTH + 1, PIECE)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(found) == 1:
        return found[0]
    at, names = (np.concatenate(x) for x in zip(*found))
    at, first = np.unique(at, return_index=True)  # strings on both sides of a cut may share an anchor
    return at, names[first]


def _anchors(b: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    h = gram_names(b)
    low = _slide(h, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    high = _slide(np.concatenate((pad, low, pad)), SPAN, np.maximum)
    at = np.flatnonzero(h == high)
    return at + begin, h[at]


def _encode(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: leading zeros compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplane(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_names(names: np.ndarray) -> bytes:
    """The upper 48 bits of sorted names: steps of the first 32, then 16. A clash of what is cut off only
    keeps a position that step 3 drops."""
    high, low = (names >> np.uint64(32)).astype(np.uint32), (names >> np.uint64(16)).astype(np.uint16)
    return _planes(np.diff(high, prepend=np.uint32(0))) + low.tobytes()


def _unpack_names(raw: bytes, n: int) -> np.ndarray:
    high = np.cumsum(_unplane(raw[: 4 * n], np.uint32), dtype=np.uint64)
    return high << np.uint64(16) | np.frombuffer(raw[4 * n :], np.uint16)


def _deal(bucket: np.ndarray, n: int):
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in range(n):
        if edge[k] < edge[k + 1]:
            yield k, order[edge[k] : edge[k + 1]]


def _bucket(names: np.ndarray, n: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _name_bucket(names: np.ndarray, n: int) -> np.ndarray:
    """Buckets of anchors' names, in the names' order and evenly filled. A share x of all names is below the
    share F(x) of anchors' names, as these are least among SPAN: F = 1 - 16 a**31 + 15 a**32, a = 1 - x.
    By products alone: every machine rounds them alike."""
    a = 1.0 - (names >> np.uint64(11)).astype(np.float64) / 2.0**53
    a2 = a * a
    a4 = a2 * a2
    a8 = a4 * a4
    a16 = a8 * a8
    share = 1.0 - 16.0 * (a16 * a8 * a4 * a2 * a) + 15.0 * (a16 * a16)
    return np.clip((share * n).astype(np.int64), 0, n - 1)


PAIRS = "bucket int, size int, names binary, docs binary, keys binary, owner binary, place binary"


def _name_positions(n_buckets: int):
    """Step 1: the anchors of every document, packed by bucket of their name."""

    def pack(ids, keys, sizes, places, names):
        owner = np.repeat(np.arange(len(ids)), sizes).astype(np.uint32)
        places, names = np.concatenate(places).astype(np.uint32), np.concatenate(names)
        rows = []
        for k, at in _deal(_name_bucket(names, n_buckets), n_buckets):
            at = at[np.argsort(names[at], kind="stable")]
            own, mine = np.unique(owner[at], return_inverse=True)
            rows.append((k, len(at), _pack_names(names[at]), ids[own].tobytes(), keys[own].tobytes(), _planes(mine.astype(np.uint32)), _planes(places[at])))
        return pd.DataFrame(rows, columns=["bucket", "size", "names", "docs", "keys", "owner", "place"])

    def run(batches):
        for pdf in batches:
            ids, keys = pdf["doc"].to_numpy("int64"), pdf["key"].to_numpy("int64")
            at, held, begin = 0, [], 0
            for i, text in enumerate(pdf["text"].tolist()):
                b = _encode(text)
                held.append(anchors(b))
                at += len(b)
                if at >= SLICE or i == len(pdf) - 1:
                    sizes = [len(p) for p, _ in held]
                    if sum(sizes):
                        yield pack(ids[begin : i + 1], keys[begin : i + 1], sizes, [p for p, _ in held], [n for _, n in held])
                    at, held, begin = 0, [], i + 1

    return run


def _runs(batches, by: str = "bucket"):
    """Rows of one bucket at a time, from batches sorted by bucket."""
    held = []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if held and getattr(held[0], by) != getattr(row, by):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _unpack(rows):
    names, docs, keys, place = [], [], [], []
    for r in rows:
        d, k = np.frombuffer(r.docs, np.int64), np.frombuffer(r.keys, np.int64)
        o = _unplane(r.owner, np.uint32)
        names.append(_unpack_names(r.names, r.size)), docs.append(d[o]), keys.append(k[o]), place.append(_unplane(r.place, np.uint32))
    return np.concatenate(names), np.concatenate(docs), np.concatenate(keys), np.concatenate(place)


def _cuts(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each document begins in sorted (key, doc)."""
    return np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1]))))


FOUND = "dest int, docs binary, keys binary, sizes binary, found binary"


def _per_document(docs: np.ndarray, keys: np.ndarray, values: np.ndarray, n: int) -> pd.DataFrame:
    """What a task found, by document (values: columns of 32 bits), packed by bucket of the document's key:
    rows that a document's repeats fill in many tasks would grow with the number of tasks."""
    order = np.lexsort((docs, keys.view(np.uint64)))
    docs, keys, values = docs[order], keys[order], values[order]
    cut = _cuts(docs, keys)
    sizes = np.diff(np.append(cut, len(docs))).astype(np.uint32)
    edge = np.searchsorted(_bucket(keys[cut].view(np.uint64), n), np.arange(n + 1))
    ends = np.append(cut, len(docs))
    rows = []
    for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
        a, b = edge[k], edge[k + 1]
        rows.append((k, docs[cut[a:b]].tobytes(), keys[cut[a:b]].tobytes(), _planes(sizes[a:b]), _planes(values[ends[a] : ends[b]].ravel())))
    return pd.DataFrame(rows, columns=["dest", "docs", "keys", "sizes", "found"])


def _assembled(width: int):
    """One row per document from the rows of _per_document, sorted by dest."""

    def run(batches):
        for rows in _runs(batches, "dest"):
            sizes = np.concatenate([_unplane(r.sizes, np.uint32) for r in rows])
            docs = np.repeat(np.concatenate([np.frombuffer(r.docs, np.int64) for r in rows]), sizes)
            keys = np.repeat(np.concatenate([np.frombuffer(r.keys, np.int64) for r in rows]), sizes)
            found = np.concatenate([_unplane(r.found, np.uint32) for r in rows]).reshape(-1, width)
            order = np.lexsort((docs, keys))
            docs, keys, found = docs[order], keys[order], found[order]
            cut = _cuts(docs, keys)
            ends = [*cut[1:].tolist(), len(docs)]
            yield pd.DataFrame({"doc": docs[cut], "key": keys[cut], "found": [found[a:b].tobytes() for a, b in zip(cut.tolist(), ends)]})

    return run


def _shared_positions(n_dests: int):
    """Step 2: sort (name, document); keep the positions whose name more than one document has."""

    def run(batches):
        parts = []
        for rows in _runs(batches):
            names, docs, keys, place = _unpack(rows)
            order = np.lexsort((docs, names))
            s, d = names[order], docs[order]
            new = np.concatenate(([True], s[1:] != s[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(s)) - 1
            many = d[first] < d[last]
            keep = order[many[np.cumsum(new) - 1]]
            parts.append((docs[keep], keys[keep], place[keep]))
        if parts:
            docs, keys, place = (np.concatenate(x) for x in zip(*parts))
            if len(docs):
                yield _per_document(docs, keys, place[:, None], n_dests)

    return run


LEFT = SPAN - 1  # bytes before an anchor that a string with it can hold
WIDE = LEFT + LENGTH  # of both sides
CONTEXTS = "bucket int, size int, docs binary, keys binary, owner binary, cls binary, place binary, room binary, left binary, bytes binary"
#: Anchors whose contexts are told apart at once.
HELD = 50_000
_WORDS = _RNG.integers(0, 2**63, WIDE // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _classes(around: np.ndarray, room: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first anchor of each class, class of each anchor): anchors of a class have equal contexts. The hash
    only proposes classes; what differs from its class's first is a class of its own."""
    ends = room.astype(np.uint64) * np.uint64(256) + left
    h = mix((around.view(np.uint64) * _WORDS).sum(axis=1, dtype=np.uint64) + ends * _A)
    _, first, mine = np.unique(h, return_index=True, return_inverse=True)
    like = first[mine]
    odd = np.flatnonzero((around.view(np.uint64) != around[like].view(np.uint64)).any(axis=1) | (room != room[like]) | (left != left[like]))
    mine[odd] = len(first) + np.arange(len(odd))
    return np.concatenate((first, odd)), mine


def _small(x: np.ndarray, n: int) -> bytes:
    return x.astype(np.uint16 if n < 65536 else np.uint32).tobytes()


def _unsmall(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if n < 65536 else np.uint32)


def _contexts(n_buckets: int):
    """Step 3, first half: each shared anchor with the bytes around it, equal ones once a batch."""

    def run(batches):
        for pdf in batches:
            held, size = [], 0
            for doc, key, text, found in zip(pdf["doc"].tolist(), pdf["key"].tolist(), pdf["text"].tolist(), pdf["found"].tolist()):
                if found is None or not len(found):
                    continue
                b = _encode(text)
                place = np.sort(np.frombuffer(found, np.uint32).astype(np.int64))
                padded = np.concatenate((np.zeros(LEFT, np.uint8), b, np.zeros(LENGTH, np.uint8)))
                around = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[place]
                held.append((doc, key, place, np.minimum(len(b) - place, LENGTH), around))
                size += len(place)
                if size >= HELD:
                    yield pack(held)
                    held, size = [], 0
            if held:
                yield pack(held)

    def pack(held):
        owner = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        docs, keys = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        place, room = np.concatenate([h[2] for h in held]).astype(np.uint32), np.concatenate([h[3] for h in held]).astype(np.uint8)
        around, left = np.concatenate([h[4] for h in held]), np.minimum(place, LEFT).astype(np.uint8)
        first, mine = _classes(around, room, left)
        around, room, left = around[first], room[first], left[first]
        bucket = _name_bucket(gram_names(np.ascontiguousarray(around[:, LEFT : LEFT + GRAM]))[:, 0], n_buckets)
        local, rows = np.empty(len(first), np.int64), []
        # every class has an anchor: both deal the same buckets
        for (k, c), (_, at) in zip(_deal(bucket, n_buckets), _deal(bucket[mine], n_buckets)):
            local[c] = np.arange(len(c))
            own, of = np.unique(owner[at], return_inverse=True)
            rows.append((k, len(c), docs[own].tobytes(), keys[own].tobytes(), _small(of, len(own)), _small(local[mine[at]], len(c)), place[at].tobytes(), room[c].tobytes(), left[c].tobytes(), around[c].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "size", "docs", "keys", "owner", "cls", "place", "room", "left", "bytes"])

    return run


STEP = 8192  # contexts named at once


def _by_name(around: np.ndarray):
    """Indexes of the contexts in slices of about STEP, all of a name together."""
    names = np.concatenate([gram_names(np.ascontiguousarray(around[a : a + STEP, LEFT : LEFT + GRAM]))[:, 0] for a in range(0, len(around), STEP)])
    order = np.argsort(names, kind="stable")
    s = names[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    cuts = first[np.unique(np.searchsorted(first, np.arange(0, len(s), STEP), side="right") - 1)]
    for a, b in zip(cuts, [*cuts[1:], len(s)]):
        yield order[a:b]


def _least(around: np.ndarray, room: np.ndarray, left: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest document that has the string, by (context, offset), from the smallest that has each
    context. One offset at a time: equal strings hold their anchor at one offset."""
    h = np.concatenate([string_names(gram_names(around[a : a + STEP])) for a in range(0, len(docs), STEP)])
    out = np.full((len(docs), SPAN), _NO_ID)
    for c in range(SPAN):
        shift = c - LEFT
        at = np.flatnonzero((left + shift >= 0) & (room >= LENGTH + shift))
        if not len(at):
            continue
        names = h[at, c]
        order = np.argsort(names, kind="stable")
        s, d = names[order], docs[at[order]]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        out[at[order], c] = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _mark(n_dests: int):
    """Step 3, second half: name the strings around each anchor, sort (name, document), mark those that a
    smaller document has."""

    def run(batches):
        parts = []
        for rows in _runs(batches):
            parts += marked(rows)
        if parts:
            docs, keys, first, end = (np.concatenate(x) for x in zip(*parts))
            if len(docs):
                yield _per_document(docs, keys, np.stack((first, end), axis=1), n_dests)

    def marked(rows):
        docs, keys, cls, place, base = [], [], [], [], 0
        for r in rows:
            d, k = np.frombuffer(r.docs, np.int64), np.frombuffer(r.keys, np.int64)
            o = _unsmall(r.owner, len(d))
            docs.append(d[o]), keys.append(k[o]), place.append(np.frombuffer(r.place, np.uint32).astype(np.int64))
            cls.append(_unsmall(r.cls, r.size).astype(np.int64) + base)
            base += r.size
        docs, keys, cls, place = (np.concatenate(x) for x in (docs, keys, cls, place))
        room, left = (np.concatenate([np.frombuffer(x, np.uint8) for x in xs]).astype(np.int64) for xs in ([r.room for r in rows], [r.left for r in rows]))
        around = np.concatenate([np.frombuffer(r.bytes, np.uint8).reshape(-1, WIDE) for r in rows])
        by = np.argsort(cls, kind="stable")
        count = np.bincount(cls, minlength=base)
        begin = np.cumsum(count) - count
        low = np.minimum.reduceat(docs[by], begin)
        for some in _by_name(around):
            least = _least(around[some], room[some], left[some], low[some])
            n = count[some]
            row = np.repeat(np.arange(len(some)), n)
            at = by[np.arange(len(row)) + np.repeat(begin[some] - (np.cumsum(n) - n), n)]
            for a in range(0, len(at), STEP):
                m = at[a : a + STEP]
                gone = np.zeros((len(m), SPAN + 2), np.int8)  # a clear column on either side
                gone[:, 1:-1] = docs[m][:, None] > least[row[a : a + STEP]]
                edge = np.diff(gone, axis=1)
                i, first = np.nonzero(edge == 1)
                _, end = np.nonzero(edge == -1)
                m = m[i]
                yield docs[m], keys[m], (place[m] + first - LEFT).astype(np.uint32), (place[m] + end - LEFT).astype(np.uint32)

    return run


def cut_spans(starts: np.ndarray) -> np.ndarray:
    """(begin, end) of the maximal runs that LENGTH-byte strings cover, from (first, end) of their starts."""
    starts = starts[np.argsort(starts[:, 0], kind="stable")]
    upto = np.maximum.accumulate(starts[:, 1] - 1 + LENGTH)
    first = np.flatnonzero(np.concatenate(([True], starts[1:, 0] > upto[:-1])))
    return np.stack((starts[first, 0], upto[np.append(first[1:], len(starts)) - 1]), axis=1)


def _cut(digest: bool):
    """The columns of the result but the id, from (text, found, copied)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = []
            for text, found, copied in zip(*[c.tolist() for c in columns]):
                b = _encode(text)
                if copied and len(b) >= LENGTH:
                    spans = np.array([[0, len(b)]])
                elif found is not None and len(found):
                    spans = cut_spans(np.frombuffer(found, np.uint32).reshape(-1, 2).astype(np.int64))
                else:
                    spans = np.empty((0, 2), np.int64)
                kept = zip([0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), len(b)])
                rest = b"".join(b[x:y].tobytes() for x, y in kept)
                if digest:
                    rows.append((len(b), len(b) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
                else:
                    rows.append((rest, [{"begin": x, "end": y} for x, y in spans.tolist()]))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["rest", "spans"])

    return F.pandas_udf(run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "rest binary, spans array<struct<begin:int,end:int>>")


def keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, text, doc (the id by which documents are ordered), key (a hash of both)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    order: Column = F.coalesce("doc_id", F.lit(int(_NO_ID)))
    return base.select("doc_id", "text", order.alias("doc"), F.xxhash64("doc_id", "text").alias("key"))


def whole_copies(base: DataFrame, n: int) -> DataFrame:
    """doc, key, copied (true): of n keyed rows, those whose whole text a smaller document has too."""
    same = base.select("doc", "key", F.sha2("text", 256).alias("sha"))
    firsts = same.groupBy("sha").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).filter("least < most")
    firsts = materialise(firsts, "firsts")
    large = F.col("n") >= max(2, HOT * n)
    hot = F.broadcast(firsts.filter(large))  # at most 1 / HOT rows
    rest = same.join(hot.select("sha"), "sha", "left_anti").join(firsts.filter(~large), "sha")
    copies = same.join(hot, "sha").unionByName(rest).filter("doc > least").select("doc", "key").distinct()
    return materialise(copies.withColumn("copied", F.lit(True)), "copies")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest: bool = True) -> DataFrame:
    """digest: doc_id, n_bytes, n_removed, n_spans, kept_sha256; else doc_id, rest BINARY, spans."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = parts * FAN
    base = keyed(docs, text_col, id_col)
    held = base.repartition(parts, "doc", "key")  # each use reads all its columns, or it would be written once more
    copies = whole_copies(base, docs.count())
    known = held.join(copies, ["doc", "key"], "left")
    alone = known.filter("copied is null").select("doc_id", "doc", "key", "text")
    pairs = alone.mapInPandas(_name_positions(buckets), PAIRS)
    shared = pairs.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInPandas(_shared_positions(parts), FOUND)
    gather = lambda f, width: f.repartitionById(parts, F.col("dest")).sortWithinPartitions("dest").mapInPandas(_assembled(width), "doc long, key long, found binary")
    around = held.join(gather(shared, 1), ["doc", "key"], "left").select("doc_id", "doc", "key", "text", "found").mapInPandas(_contexts(buckets), CONTEXTS)
    marked = around.repartitionById(parts, F.col("bucket")).sortWithinPartitions("bucket").mapInPandas(_mark(parts), FOUND)
    last = held.join(gather(marked, 2), ["doc", "key"], "left").join(copies, ["doc", "key"], "left")
    return last.select("doc_id", _cut(digest)("text", "found", F.coalesce("copied", F.lit(False))).alias("c")).select("doc_id", "c.*")
