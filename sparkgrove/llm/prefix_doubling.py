"""Substring dedup by distributed prefix doubling: sorted (position, rank) pairs in Spark rounds.

The same result as substring_dedup.remove_repeats, by the other method:

1. Every byte position of every text gets the rank of the 8 bytes from it: the bytes themselves as a number.
2. In rounds at offsets 8, 16 and 18 a position's rank is paired with that of the position so far behind
   it. Pairs are sorted and ranked anew, so ranks stand for 16, 32 and then LENGTH bytes, in order.
3. Between rounds a position retires if one document alone has its pair. What follows a retired position
   by an offset is not needed: a string whose second half is unique is unique itself.
4. After the last round a position whose rank a smaller document has too starts a repeat.

Nothing is hashed: ranks are exact. Each round is written to the shared folder, so a lost executor costs at
most a round. Whole copies of a text are settled first, as in remove_repeats. The first round moves every
position of the corpus, which the README gives figures of; the registered query takes anchors instead.

Cases: those of remove_repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.llm.substring_dedup import LENGTH, _cut, _encode, keyed, whole_copies
from sparkgrove.session import discard, materialise

FIRST = 8
#: Offsets of the rounds: ranks of 8 bytes become ranks of 16, 32 and LENGTH.
OFFSETS = (8, 16, LENGTH - 32)
#: Positions that go to Spark in one batch.
SLICE = 1 << 18
POSITIONS = "doc long, key long, at int, rank long"


def _positions(batches):
    for pdf in batches:
        for doc, key, text in zip(pdf["doc"].tolist(), pdf["key"].tolist(), pdf["text"].tolist()):
            b = _encode(text)
            if len(b) < LENGTH:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(b, FIRST)
            for a in range(0, len(windows), SLICE):
                rank = np.ascontiguousarray(windows[a : a + SLICE]).view(">i8").ravel().astype(np.int64)
                yield pd.DataFrame({"doc": doc, "key": key, "at": np.arange(a, a + len(rank), dtype=np.int32), "rank": rank})


def rerank(ranks: DataFrame, offset: int) -> DataFrame:
    """doc, key, at, rank, least: the pairs at this offset that more than one document has, ranked in
    their order, with the smallest document of each."""
    ahead = W.partitionBy("doc", "key").orderBy("at").rangeBetween(offset, offset)
    pairs = ranks.select("doc", "key", "at", F.col("rank").alias("a"), F.max("rank").over(ahead).alias("b")).filter("b is not null")
    pairs = materialise(pairs, "pairs")
    shared = pairs.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    order = shared.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("a", "b", "least", F.monotonically_increasing_id().alias("rank"))
    out = materialise(pairs.join(materialise(order, "order"), ["a", "b"]).select("doc", "key", "at", "rank", "least"), "ranks")
    discard(pairs)
    return out


def remove_repeats_by_doubling(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest: bool = True) -> DataFrame:
    """The columns of remove_repeats."""
    base = keyed(docs, text_col, id_col)
    copies = whole_copies(base, docs.count())
    texts = base.dropDuplicates(["doc", "key"]).join(copies, ["doc", "key"], "left_anti").select("doc", "key", "text")
    ranks = texts.mapInPandas(_positions, POSITIONS)
    for offset in OFFSETS:
        ranks = rerank(ranks, offset)

    @F.pandas_udf("binary")
    def packed(starts: pd.Series) -> pd.Series:
        return starts.map(lambda s: np.stack((np.asarray(s), np.asarray(s) + 1), axis=1).astype(np.uint32).tobytes())

    found = ranks.filter("doc > least").groupBy("doc", "key").agg(F.collect_list("at").alias("starts"))
    found = found.select("doc", "key", packed("starts").alias("found"))
    last = base.join(found, ["doc", "key"], "left").join(copies, ["doc", "key"], "left")
    return last.select("doc_id", _cut(digest)("text", "found", F.coalesce("copied", F.lit(False))).alias("c")).select("doc_id", "c.*")
