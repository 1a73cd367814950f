"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is indexed. A query
probes its nearest cells; in a cell, per-query distance tables rank the codes (asymmetric: the query is
not quantised). A code's score is wrong by at most the vector's quantisation error: every vector whose score
plus error reaches the k-th score less error is reranked by exact cosine, however many they are, so within
the probed cells the result is exact. Cells are split into slices of bounded size, so a hot cell is many
tasks.

Cases: vectors that are null, zero, empty, or hold null or non-finite components take no part, as queries
or candidates; one shorter than the longest counts as followed by zeros; ties go to the smaller id; rows that repeat an id are
separate candidates, never of a query with that id, and queries of their own unless wholly equal; fewer candidates than k gives them all; null ids take
no part; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bound of the fitting sample, in vectors.
SAMPLE = 20_000
MAX_CELLS = 4096
SUBSPACES, CODES = 16, 64
#: Vectors that a slice of a cell holds on average.
SLICE = 2048
#: Pairs of a query and a vector scored at once.
PAIRS = 1 << 16
#: Rounding of the quantised scores and their error bounds, in single precision, and of exact ones by blocks.
ROUNDING, EXACT_ROUNDING = 1e-5, 1e-12
#: Probes are set so that this share of the sample's true neighbours lies in probed cells.
TARGET, TRIALS, LEAST_PROBES = 0.97, 256, 8
SEED = 11


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    x = x.astype(np.float32)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - x[at : at + 4096] @ c.T).argmin(axis=1)
    return out


class Index:
    """Fitted parts: unit-vector centroids, and per subspace the codebook of residuals."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        unit = np.unique((sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32), axis=0)
        self.dims = unit.shape[1]
        self.centroids = _kmeans(unit, min(MAX_CELLS, max(1, int(math.sqrt(n)))))
        residual = unit - self.centroids[nearest_centroid(unit, self.centroids)]
        self.parts = np.array_split(np.arange(self.dims), min(SUBSPACES, self.dims))
        self.books = [_kmeans(residual[:, p], CODES, 6) for p in self.parts]
        self.n_probes = self._calibrate(unit)

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest_centroid(unit, self.centroids)
        residual = unit - self.centroids[cell]
        return cell, np.stack([nearest_centroid(residual[:, p], b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)

    def errors(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """How far each vector lies from its quantised form: no unit query scores it wrong by more."""
        e = unit - self.centroids[cell]
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            e[:, p] -= b[codes[:, i]]
        return np.sqrt((e * e).sum(axis=1))

    def _distances(self, unit: np.ndarray) -> np.ndarray:
        return (self.centroids * self.centroids).sum(axis=1) / 2 - unit @ self.centroids.T

    def _calibrate(self, unit: np.ndarray, k: int = 5) -> int:
        """How far down a query's list of cells its true neighbours within the sample lie."""
        q = np.random.default_rng(SEED).permutation(len(unit))[:TRIALS]
        score = unit[q] @ unit.T
        score[np.arange(len(q)), q] = -np.inf
        k = min(k, len(unit) - 1)
        if k < 1:
            return len(self.centroids)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        place = self._distances(unit[q]).argsort(axis=1).argsort(axis=1)
        depth = place[np.arange(len(q))[:, None], nearest_centroid(unit, self.centroids)[near]]
        return min(len(self.centroids), max(LEAST_PROBES, int(np.quantile(depth, TARGET)) + 1))

    def probes(self, unit: np.ndarray) -> np.ndarray:
        return np.argpartition(self._distances(unit), self.n_probes - 1, axis=1)[:, : self.n_probes]

    def scores(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries with the quantised vectors of a cell, by tables of query and code."""
        out = np.repeat((unit @ self.centroids[cell])[:, None], len(codes), axis=1)
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            out += (unit[:, p] @ b.T)[:, codes[:, i]]
        return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to [1/2, 1): no square of what counts is
    too large or too small, and no digit of it changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines of the rows of q with those of x, in double; equal rows give equal bits."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((x * x).sum(axis=1)))


def units(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = scaled(np.stack(pdf["v"]))
    return x, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


NONE = pd.DataFrame({"query_id": np.array([], "int64"), "q": np.array([], "int64"), "vec_id": np.array([], "int64"), "score": np.array([], "float64")})


def nearest(index: Index, q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, q, vec_id, score: the k nearest to each query (q names its vector) among the vectors of one slice of a cell."""
    x = x.sort_values("vec_id", kind="stable")
    ids, cell = x["vec_id"].to_numpy(), int(x["cell"].iloc[0])
    codes = np.frombuffer(b"".join(x["codes"]), np.uint8).reshape(len(x), -1)
    full, unit = units(x)
    error = index.errors(unit, cell, codes)
    exact = full / np.linalg.norm(full, axis=1, keepdims=True)
    asked, named, (full_q, unit_q) = q["vec_id"].to_numpy(), q["q"].to_numpy(), units(q)
    exact_q = full_q / np.linalg.norm(full_q, axis=1, keepdims=True)
    # a slice of k vectors or fewer gives them all
    kth = lambda s: np.partition(s, -k, axis=1)[:, -k, None] if k < s.shape[1] else np.full((len(s), 1), -np.inf)
    found, step = [], max(1, PAIRS // len(x))
    for a in range(0, len(q), step):
        b = slice(a, a + step)
        own = asked[b, None] == ids[None]
        score = index.scores(unit_q[b], cell, codes)
        reach = ~own & (score + error >= kth(np.where(own, -np.inf, score - error)) - ROUNDING)
        some = np.flatnonzero(reach.any(axis=0))
        if not len(some):
            continue
        score = np.where(own[:, some], -np.inf, exact_q[b] @ exact[some].T)
        i, j = np.nonzero(~own[:, some] & (score >= kth(score) - EXACT_ROUNDING))
        i, j = i + a, some[j]
        final = cosine(full_q[i], full[j])
        order = np.lexsort((ids[j], -final, i))
        order = order[np.arange(len(i)) - np.searchsorted(i, i[order]) < k]  # i ascends before and after
        found.append(pd.DataFrame({"query_id": asked[i[order]], "q": named[i[order]], "vec_id": ids[j[order]], "score": final[order]}))
    return pd.concat(found) if found else NONE


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v ARRAY<DOUBLE> of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~bad & F.exists("v", lambda x: x != 0))
    longest = v.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))
    return v.select("vec_id", F.when(F.size("v") == longest, F.col("v")).otherwise(padded).alias("v"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by every."""
    out = "query_id long, q long, vec_id long, score double"
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col)
    n = good.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    draw = F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    rows = good.filter(draw).select("v").limit(2 * SAMPLE).toPandas()
    if not len(rows):
        rows = good.select("v").limit(SAMPLE).toPandas()
    index = Index(scaled(np.stack(rows["v"])), n)
    shared = spark.sparkContext.broadcast(index)
    slice_of = F.pmod(F.xxhash64(F.lit("slice"), "vec_id"), F.col("slices")).cast("int")

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                cell, codes = shared.value.encode(units(pdf)[1])
                yield pdf.assign(cell=cell.astype("int32"), codes=[c.tobytes() for c in codes])

    def probe(batches):
        for pdf in batches:
            if len(pdf):
                p = shared.value.probes(units(pdf)[1])
                yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), p.shape[1]), "q": np.repeat(pdf["q"].to_numpy(), p.shape[1]), "v": np.repeat(pdf["v"].to_numpy(), p.shape[1]), "cell": p.ravel().astype("int32")})

    listed = good.mapInPandas(encode, "vec_id long, v array<double>, cell int, codes binary")
    # at most MAX_CELLS rows, whatever the input
    sizes = good.mapInPandas(encode, "vec_id long, v array<double>, cell int, codes binary").groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sizes = F.broadcast(sizes)
    listed = listed.join(sizes, "cell").withColumn("slice", slice_of).drop("slices")
    queries = good.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"]).select("vec_id", F.xxhash64("v").alias("q"), "v")
    asked = queries.mapInPandas(probe, "vec_id long, q long, v array<double>, cell int")
    asked = asked.join(sizes, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def answer(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return NONE
        return nearest(shared.value, q, x, k)

    pairs = asked.groupBy("cell", "slice").cogroup(listed.groupBy("cell", "slice")).applyInPandas(answer, out)
    rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
