"""Points to tree to dendrogram."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrove.operators.dendrogram import dendrogram
from sparkgrove.operators.knn import BLOCK_SIZE, core_distance, knn_blocks
from sparkgrove.operators.mst import LISTED, PAIR_BLOCK, mst
from sparkgrove.session import materialise
from sparkgrove.sources.points import validate


def density_tree(points: DataFrame, min_pts: int, max_dim: int = 20, timings: dict | None = None, block_size: int | None = None, rounds: list | None = None) -> DataFrame:
    """u < v, weight: the spanning tree under mutual reachability. min_pts = 1 gives the Euclidean tree.
    timings gets the seconds of the phases, rounds those of each round of block pairs."""
    began = time.perf_counter()
    points, n, d = validate(points, max_dim)
    if n < 2:
        raise ValueError("at least 2 points are needed")
    if not 1 <= min_pts <= n:
        raise ValueError(f"min_pts is {min_pts}, with {n} points")
    near = None
    if min_pts > 1 and points.groupBy("c").count().filter(F.col("count") >= min_pts).isEmpty():  # the lists serve the tree as well
        near = materialise(knn_blocks(points, n, min(n, max(min_pts, LISTED)), d, block_size or BLOCK_SIZE), "near")
        cd = near.filter(F.col("rank") == min_pts).select("id", F.col("dist").alias("cd"))
    else:  # copies stay out of the tree's lists
        cd = core_distance(points, min_pts, max_dim, block_size or BLOCK_SIZE)
    points_cd = materialise(points.join(cd, "id"), "core")
    if timings is not None:
        timings["core-dist"] = time.perf_counter() - began
    tree = mst(points_cd, n, d, block_size or PAIR_BLOCK, rounds, near)
    if timings is not None:
        timings["tree"] = time.perf_counter() - began - timings["core-dist"]
    return tree


def euclidean_tree(points: DataFrame, max_dim: int = 20) -> DataFrame:
    return density_tree(points, 1, max_dim)


def dendrogram_of(points: DataFrame, min_pts: int, max_dim: int = 20) -> DataFrame:
    """merge_idx, left, right, height, size of points with dense ids 0..n-1."""
    n = points.count()
    return dendrogram(materialise(density_tree(points, min_pts, max_dim), "tree"), n)


linkage = dendrogram_of


def to_linkage(merges: DataFrame) -> np.ndarray:
    """The float64 matrix (n-1) x 4 that plotting tools take."""
    return merges.orderBy("merge_idx").select("left", "right", "height", "size").toPandas().to_numpy(np.float64)
