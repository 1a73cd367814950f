"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

A signature has 64 symbols of 16 bits. It is split into m chunks; two signatures that differ in at most
2m - 1 symbols have, by pigeonhole, a chunk that differs in at most one, so each chunk is indexed once
per symbol left out. All pairs under that distance share a key. Texts with one shingle set are one class.
Keys tie classes into coarse groups (a key's members to its least, never pairs with pairs); within a
group a prefix filter on its rarest shingles finds what can still reach the similarity, what already lies
in one component is skipped, pairs whose signatures differ in more than 2m - 1 symbols are dropped, and
the rest is confirmed on full sets. Large groups are compared in pairs of blocks, so no task holds more
than two blocks.

Cases: a null, empty or blank text has no shingles and is linked with nothing; fewer words than the
shingle width are one shingle; ties have no order that matters; rows that repeat an id are one document;
rows with a null id are kept and linked with nothing; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrove.llm.components import components
from sparkgrove.llm.membership import split
from sparkgrove.llm.shingles import SYMBOLS, shingle_set, signature
from sparkgrove.session import materialise

#: Classes that a block holds on average.
BLOCK = 1024


def chunks_for(percent: int) -> int:
    """Chunks m such that 2m - 1 errors lie 4.7 deviations above what the least similarity gives: a pair
    at exactly that similarity is missed with probability about 1e-5."""
    p = 1 - percent / 100
    errors = SYMBOLS * p + 4.7 * math.sqrt(SYMBOLS * p * (1 - p))
    return max(1, math.ceil((errors + 1) / 2))


def signatures(docs: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """doc_id, n (shingles), print (128-bit hash of the set), sig (128 bytes); null print without shingles."""

    @F.pandas_udf("n long, print binary, sig binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, prints, sigs = [], [], []
            for t in texts.tolist():
                s = shingle_set(t, width)
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"n": n, "print": prints, "sig": sigs})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(text_col).cast("string")).alias("s")).select("doc_id", "s.*")


def index_keys(sig: Column, m: int) -> Column:
    """One 64-bit key per (chunk, symbol left out)."""
    bounds = np.linspace(0, SYMBOLS, m + 1).astype(int).tolist()
    keys = []
    for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for out in range(a, b):
            keys.append(F.xxhash64(F.lit(c * SYMBOLS + out), F.substring(sig, 2 * a + 1, 2 * (out - a)), F.substring(sig, 2 * out + 3, 2 * (b - out - 1))))
    return F.array(*keys)


def groups_of_rows(batches, keys: list[str]):
    """Runs of rows with equal keys, whole, from sorted batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        change[0] = bool(held) and tuple(pdf[keys].iloc[0]) != tuple(held[-1][keys].iloc[-1])
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if (k or change[0]) and held:
                yield pd.concat(held)
                held = []
            if b > a:
                held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held)


def links_within(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """Links that join everything linked in a group: a spanning forest of its similarity graph.

    across: only pairs of different sides count (both sides alone are other groups' work). Candidates are
    pairs within the Hamming distance that chunks_for(percent) guarantees the index to find.
    """
    most = 2 * chunks_for(percent) - 1
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sides, sets = ids[order], sides[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, name, df = np.unique(flat, return_inverse=True, return_counts=True)
    rarity = df[name]
    by = np.lexsort((name, rarity, owner))
    starts = np.cumsum(sizes) - sizes
    within = np.arange(len(flat)) - np.repeat(starts, sizes)
    need = -(-percent * sizes // 100)  # at least this overlap with any partner
    prefix = by[within < np.repeat(sizes - need + 1, sizes)]
    prefix = prefix[rarity[prefix] > 1]
    p_name, p_owner = name[prefix], owner[prefix]
    post = np.lexsort((p_owner, p_name))
    p_name, p_owner = p_name[post], p_owner[post]
    begin = np.searchsorted(p_name, p_name)
    mine = np.argsort(p_owner, kind="stable")
    edge = np.searchsorted(p_owner[mine], np.arange(len(sets) + 1))
    root = np.arange(len(sets))
    sigs, signed = np.zeros((len(sets), SYMBOLS), np.uint16), np.zeros(len(sets), bool)

    def sign(some: np.ndarray) -> None:
        for i in some[~signed[some]].tolist():
            sigs[i], signed[i] = signature(sets[i]), True

    out = []
    for x in range(len(sets)):
        at = mine[edge[x] : edge[x + 1]]
        earlier = [p_owner[begin[k] : k] for k in at.tolist() if begin[k] < k]
        if not earlier:
            continue
        cand = np.unique(np.concatenate(earlier))
        cand = cand[(root[cand] != root[x]) & (100 * sizes[cand] >= percent * sizes[x]) & (ids[cand] != ids[x])]
        if across:
            cand = cand[sides[cand] != sides[x]]
        if len(cand):
            sign(np.append(cand, x))
            cand = cand[(sigs[cand] != sigs[x]).sum(axis=1) <= most]
        while len(cand):
            y = cand[0]
            both = np.count_nonzero(_member(sets[y], sets[x]))
            if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                out.append((int(ids[y]), int(ids[x])))
                root[root == root[y]] = root[x]
                cand = cand[root[cand] != root[x]]
            else:
                cand = cand[1:]
    return out


def _member(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return large[at] == small


def _full_sets(rows: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pdf[["doc_id", "comp", "blocks"]].assign(members=[shingle_set(t, width).tobytes() for t in pdf["text"].tolist()])

    return rows.mapInPandas(run, "doc_id long, comp long, blocks int, members binary")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: linked where
    100 * intersection >= percent * union of the distinct shingle sets."""
    sigs = materialise(signatures(docs, width, text_col, id_col), "signatures")
    classes = materialise(sigs.filter("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    keys = classes.select(F.col("rep").alias("node"), F.explode(index_keys(F.col("sig"), chunks_for(percent))).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key", "lo")
    coarse = components(keys.join(shared.hint("merge"), "key").filter("node <> lo").select(F.col("lo").alias("u"), F.col("node").alias("v")))
    coarse = materialise(coarse, "coarse")
    blocks = coarse.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = coarse.join(blocks, "comp").select(F.col("node").alias("rep"), "comp", "blocks")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts, _ = split(texts, F.xxhash64("doc_id"), members.select(F.xxhash64("rep")))
    full = _full_sets(texts.join(members.hint("merge"), texts["doc_id"] == members["rep"]).select("doc_id", "comp", "blocks", "text"), width)
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    units = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("doc_id", "members", "comp", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(batches):
        found = []
        for g in groups_of_rows(batches, ["comp", "a", "b"]):
            g = g[g["members"].str.len() > 0]
            if len(g) > 1:
                sets = [np.frombuffer(m, np.uint64) for m in g["members"]]
                across = g["a"].iloc[0] != g["b"].iloc[0]
                found += links_within(g["doc_id"].to_numpy(), g["own"].to_numpy(), sets, percent, across)
        yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = units.repartition(parts, "comp", "a", "b").sortWithinPartitions("comp", "a", "b")
    # written before components() runs Python of its own: one Python worker a task, not two
    linked = components(materialise(placed.mapInPandas(compare, "u long, v long"), "pairs"))
    named = classes.join(linked, classes["rep"] == linked["node"], "left").select("print", F.coalesce("comp", "rep").alias("component"))
    left = sigs.select("doc_id", "n", F.col("print").alias("p"))
    out = left.join(named, (left["p"] == named["print"]) & left["doc_id"].isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, one document of each component, with all their columns."""
    gone = near_groups(docs, width, percent, text_col, id_col).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = materialise(gone, "gone")
    # whole rows travel only where they may go
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("_id"))
    maybe, sure = split(rows, F.when(F.col("_id").isNotNull(), F.xxhash64("_id")), gone.select(F.xxhash64("_gone")))
    stay = maybe.join(gone, maybe["_id"] == gone["_gone"], "left_anti")
    return sure.unionByName(stay).select("row.*")
