"""k-nearest-neighbour self-joins. The point itself is the first neighbour; ties go to the smaller id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.functions.vector import unrolled_distance
from sparkgrove.operators.blocks import assign_blocks, block_table, box_gaps, fit_splits
from sparkgrove.session import materialise, tasks
from sparkgrove.sources.points import validate

BLOCK_SIZE = 2048
CHUNK = 512
#: Distances held at once.
HELD = 1 << 22


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, squared terms added in dimension order (bit-equal to the SQL expression)."""
    acc = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j, None] - b[None, :, j]
        acc += diff * diff
    return np.sqrt(acc)


def _chunk(n: int) -> int:
    return max(1, min(CHUNK, HELD // max(n, 1)))


def nearest(a: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, id in b, distance) of the k nearest, ties at the k-th place settled by id."""
    rows, ids, dists = [], [], []
    step = _chunk(len(b))
    for at in range(0, len(a), step):
        d = distances(a[at : at + step], b)
        if len(b) > k:
            limit = np.partition(d, k - 1, axis=1)[:, k - 1]
            r, c = np.nonzero(d <= limit[:, None])
        else:
            r, c = np.nonzero(np.ones_like(d, bool))
        v, i = d[r, c], b_ids[c]
        order = np.lexsort((i, v, r))
        r, v, i = r[order], v[order], i[order]
        first = np.searchsorted(r, np.arange(len(d)))
        keep = np.arange(len(r)) - first[r] < k
        rows.append(r[keep] + at), ids.append(i[keep]), dists.append(v[keep])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(dists)


def knn_bruteforce(points: DataFrame, k: int, dims: int) -> DataFrame:
    """Nested loop form, quadratic: the check of the others. Cross join and a per-query top k (WindowGroupLimit)."""
    pairs = points.alias("a").crossJoin(points.alias("b")).select(F.col("a.id").alias("id"), F.col("b.id").alias("nbr"), unrolled_distance("a", "b", dims).alias("dist"))
    rank = F.row_number().over(W.partitionBy("id").orderBy("dist", "nbr"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "nbr", "dist")


#: From so many dimensions on boxes keep few blocks out of reach: all pairs of large blocks are compared.
PAIR_DIMS = 8
PAIR_POINTS = 16_384
#: Squared distances of one product.
STRIP = 1 << 20


def _lifted(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices whose product holds the squared distances of x to y, and what it can be off by at most. In single
    precision where that is little beside least."""
    centre = y.mean(axis=0)
    x, y = x - centre, y - centre
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    size, kind = xx.max() + yy.max(), np.float32
    off = (x.shape[1] + 8) * 2.0**-22 * size
    if not (1e-20 < size < 1e30 and off <= least * 2.0**-6):
        off, kind = off * 2.0**-29, np.float64
    a = np.column_stack([-2.0 * x, xx, np.ones(len(x))]).astype(kind)
    return a, np.vstack([y.T, np.ones(len(y)), yy]).astype(kind), off


def _first(rows: list, k: int) -> list:
    """Of (id, nbr, dist) arrays the k nearest of each id."""
    i, j, d = map(np.concatenate, zip(*rows))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return [(i[keep], j[keep], d[keep])]


def near_of_pair(x: np.ndarray, ids: np.ndarray, most: np.ndarray, y: np.ndarray, y_ids: np.ndarray, y_most: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, nbr, dist: the k nearest in the other block of each point, of those whose squared distance is most at
    most. y_most None: only x asks. Products choose, distances() decides."""
    found, held = [(np.array([], "int64"), np.array([], "int64"), np.array([], "float64"))], 0
    every = most if y_most is None else np.concatenate([most, y_most])
    few = len(every) // 20
    a, b, off = _lifted(x, y, float(np.partition(every, few)[few]))
    up = lambda r: np.nextafter((r + off).astype(a.dtype), a.dtype.type(np.inf))
    far, y_far = up(most), None if y_most is None else up(y_most)
    step = max(1, STRIP // len(y))
    for at in range(0, len(x), step):
        d = a[at : at + step] @ b
        asks = [(d > far[at : at + step, None], False)]
        if y_most is not None:
            asks.append((d > y_far[None], True))
        for mask, back in asks:
            r, c = np.divmod(np.flatnonzero(~mask), len(y))
            acc = np.zeros(len(r))
            for j in range(x.shape[1]):
                diff = x[r + at, j] - y[c, j]
                acc += diff * diff
            i, j = ids[r + at], y_ids[c]
            found.append((j, i, np.sqrt(acc)) if back else (i, j, np.sqrt(acc)))
            held += len(r)
        if held > HELD:
            found = _first(found, k)
            held = 0
    return _first(found, k)[0]


def _knn_pairs(blocked: DataFrame, k: int, dims: int) -> DataFrame:
    """id, nbr, dist: at least the k nearest. A radius from each point's own block, then all pairs of blocks that it
    can reach, each in one task by a matrix product: a block travels once per pair it is in."""
    spark = blocked.sparkSession
    count = blocked.select("block").distinct().count()

    def radii(pdf: pd.DataFrame) -> pd.DataFrame:
        x, most = np.stack(pdf["c"]), np.full(len(pdf), np.inf)
        if len(x) >= k:
            a, b, off = _lifted(x, x, 0.0)
            step = _chunk(len(x))
            for at in range(0, len(x), step):
                d = a[at : at + step] @ b
                most[at : at + step] = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * off
        return pdf.assign(most=np.where(np.isnan(most), np.inf, most))

    p = materialise(blocked.repartition(tasks(spark, count), "block").groupBy("block").applyInPandas(radii, "id long, c array<double>, block int, most double"), "radii")
    t = block_table(p, dims).merge(p.groupBy("block").agg(F.max("most").alias("most")).toPandas(), on="block")
    lo, hi, most, numbers = np.stack(t["lo"]), np.stack(t["hi"]), t["most"].to_numpy(), t["block"].to_numpy()
    i, j = np.triu_indices(len(t))
    near = box_gaps(lo, hi, lo, hi)[i, j] ** 2 * (1.0 - 1e-12) <= np.maximum(most[i], most[j])
    pairs = spark.createDataFrame(pd.DataFrame({"x": numbers[i[near]], "y": numbers[j[near]]}).astype("int32"))
    sides = F.broadcast(pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")))

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        left = (pdf["block"] == pdf["x"]).to_numpy()
        x, ids, r = np.stack(pdf["c"]), pdf["id"].to_numpy(), pdf["most"].to_numpy()
        rows = near_of_pair(x, ids, r, x, ids, None, k) if left.all() else near_of_pair(x[left], ids[left], r[left], x[~left], ids[~left], r[~left], k)
        return pd.DataFrame(dict(zip(("id", "nbr", "dist"), rows)))

    asked = p.join(sides, "block").repartition(tasks(spark, int(near.sum())), "x", "y")
    return asked.groupBy("x", "y").applyInPandas(answer, "id long, nbr long, dist double")


def knn_blocks(points: DataFrame, n: int, k: int, dims: int, block_size: int = BLOCK_SIZE, pair_points: int = PAIR_POINTS) -> DataFrame:
    """Block form: a local top k bounds each query's radius, then only blocks within it are probed.

    Of points with equal coordinates the k smallest ids enter the blocks: no other can be among the k nearest of
    any point, and the rest have just those k as neighbours, at distance 0. So no block fills with copies.
    Shuffles: points by coordinates (k a group and task), by block once per phase; probes carry one row per
    (query, reachable block). From PAIR_DIMS dimensions on pairs of blocks of pair_points are compared instead.
    """
    copy = F.row_number().over(W.partitionBy("c").orderBy("id"))
    few = points.select("id", "c").withColumn("_copy", copy).filter(F.col("_copy") <= k).drop("_copy")
    paired = dims >= PAIR_DIMS
    splits = fit_splits(points, n, max(block_size, 2 * k, pair_points if paired else 0))
    blocked = materialise(assign_blocks(few, splits), "blocked")  # read four times
    crowds = materialise(blocked.groupBy("c").agg(F.sort_array(F.collect_list("id")).alias("first")).filter(F.size("first") == k), "crowds")  # k ids each
    found = _knn_pairs(blocked, k, dims) if paired else _knn_probes(blocked, k, dims)
    rank = F.row_number().over(W.partitionBy("id").orderBy("dist", "nbr"))
    near = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "nbr", "dist")
    if crowds.isEmpty():
        return near
    rest = points.join(crowds, "c").filter(F.col("id") > F.col("first")[k - 1])
    copies = rest.select("id", F.posexplode("first").alias("rank", "nbr"))
    return near.unionByName(copies.select("id", (F.col("rank") + 1).alias("rank"), "nbr", F.lit(0.0).alias("dist")))


def _knn_probes(blocked: DataFrame, k: int, dims: int) -> DataFrame:
    """id, nbr, dist: at least the k nearest, from the blocks within each point's radius."""
    table = block_table(blocked, dims)
    lo, hi = np.stack(table["lo"]), np.stack(table["hi"])
    numbers = table["block"].to_numpy()
    by_block = lambda t: t.repartition(tasks(blocked.sparkSession, len(numbers)), "block").groupBy("block")

    def probes(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, own = np.stack(pdf["c"]), pdf["id"].to_numpy(), int(pdf["block"].iloc[0])
        radius = np.full(len(x), np.inf)
        if len(x) >= k:
            step = _chunk(len(x))
            for at in range(0, len(x), step):
                radius[at : at + step] = np.partition(distances(x[at : at + step], x), k - 1, axis=1)[:, k - 1]
        out = []
        for at in range(0, len(x), CHUNK):
            q, b = np.nonzero(box_gaps(x[at : at + CHUNK], x[at : at + CHUNK], lo, hi) <= radius[at : at + CHUNK, None])
            out.append(pd.DataFrame({"block": numbers[b].astype("int32"), "id": ids[q + at], "row": q + at}))
        out = pd.concat(out)
        out["c"] = [x[r] for r in out.pop("row")]
        return out

    probe = by_block(blocked).applyInPandas(probes, "block int, id long, c array<double>")

    def answer(key, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"id": np.array([], "int64"), "nbr": np.array([], "int64"), "dist": np.array([], "float64")})
        r, i, d = nearest(np.stack(q["c"]), np.stack(b["c"]), b["id"].to_numpy(), k)
        return pd.DataFrame({"id": q["id"].to_numpy()[r], "nbr": i, "dist": d})

    return by_block(probe).cogroup(by_block(blocked)).applyInPandas(answer, "id long, nbr long, dist double")


def knn(points: DataFrame, k: int, max_dim: int = 20, block_size: int = BLOCK_SIZE) -> DataFrame:
    """id, rank (from 1), nbr, dist. ValueError for k < 1 or k > n."""
    points, n, d = validate(points, max_dim)
    if not 1 <= k <= n:
        raise ValueError(f"k is {k}, with {n} points")
    return knn_blocks(points, n, k, d, block_size)


def core_distance(points: DataFrame, min_pts: int, max_dim: int = 20, block_size: int = BLOCK_SIZE) -> DataFrame:
    """id, cd: distance to the min_pts-th neighbour, the point itself counted."""
    if min_pts == 1:
        points, n, _ = validate(points, max_dim)
        return points.select("id", F.lit(0.0).alias("cd"))
    return knn(points, min_pts, max_dim, block_size).filter(F.col("rank") == min_pts).select("id", F.col("dist").alias("cd"))
