"""Pairs of nodes of a box tree: the well-separated pair decomposition, in rounds over a frontier of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrove.functions import boxes as B
from sparkgrove.operators.blocks import Splits, assign_blocks, fit_splits
from sparkgrove.operators.knn import HELD, distances
from sparkgrove.operators.mst import EDGES, _prim, components, kruskal
from sparkgrove.session import materialise, tasks


def _paths(splits: Splits) -> list[tuple[int, int, int]]:
    """(leaf, node above it or itself, that node's parent)."""
    up = np.full(len(splits.dim), -1)
    inner = np.flatnonzero(splits.dim >= 0)
    up[splits.left[inner]] = up[splits.right[inner]] = inner
    path = []
    for k in np.flatnonzero(splits.dim < 0).tolist():
        node = k
        while node >= 0:
            path.append((k, node, int(up[node])))
            node = int(up[node])
    return path


def box_tree(points: DataFrame, n: int, dims: int, block_size: int, splits: Splits | None = None) -> DataFrame:
    """node, a, b (its children that hold points; null in leaves), lo, hi, n, diameter, cd_min, cd_max (0 for points
    without cd): leaves and the boxes above them. Points are aggregated once, to leaves; the rest is a table of
    two rows a block."""
    splits = splits or fit_splits(points, n, block_size)
    corner = lambda f, k: F.array(*[f(F.col(k)[i]) for i in range(dims)])
    cd = F.col("cd") if "cd" in points.columns else F.lit(0.0)
    cores = [F.min(cd).alias("cd_min"), F.max(cd).alias("cd_max")]
    leaves = assign_blocks(points, splits).groupBy("block").agg(corner(F.min, "c").alias("lo"), corner(F.max, "c").alias("hi"), F.count("*").alias("n"), *cores)
    above = points.sparkSession.createDataFrame(_paths(splits), "block int, node int, parent int")
    cores = [F.min("cd_min").alias("cd_min"), F.max("cd_max").alias("cd_max")]
    nodes = leaves.join(above, "block").groupBy("node", "parent").agg(corner(F.min, "lo").alias("lo"), corner(F.max, "hi").alias("hi"), F.sum("n").alias("n"), *cores)
    nodes = materialise(nodes.withColumn("diameter", B.diagonal("lo", "hi")), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("a"), F.max("node").alias("b"))
    return materialise(nodes.drop("parent").join(children, "node", "left"), "tree")


def wspd(tree: DataFrame, s: float = 2.0, rounds: int = 10_000, mutual: bool = False, drop=None) -> DataFrame:
    """u, v, n_u, n_v, separated, lower: every two points of different leaves lie in exactly one pair. Pairs of
    leaves that aren't well separated end the descent with separated = false.

    Of a pair that isn't separated the node with the larger diameter is split (the only one that has children,
    if one is a leaf); a round takes every pair of the frontier one step. mutual: separated in mutual reachability
    is enough. lower is the least weight max(distance, cd, cd) that a pair can have, upper the largest; pairs for
    which drop(lower, upper) holds leave the descent, with all below them.
    """
    side = lambda t: tree.select(*[F.col(c).alias(f"{t}_{c}") for c in tree.columns])
    boxes = ("u_lo", "u_hi", "v_lo", "v_hi")
    lower = F.greatest(B.min_distance(*boxes), F.col("u_cd_min"), F.col("v_cd_min")) * (1.0 - 1e-12)
    upper = F.greatest(B.far_distance(*boxes), F.col("u_cd_max"), F.col("v_cd_max")) * (1.0 + 1e-12)
    core = ("cd_min", "cd_max")
    apart = B.unreachable(*[f"{t}_{k}" for t in "uv" for k in ("lo", "hi", *core)]) if mutual else B.well_separated(*boxes, s)
    ends = apart | (F.col("u_a").isNull() & F.col("v_a").isNull())
    split_u = F.col("u_a").isNotNull() & (F.col("v_a").isNull() | (F.col("u_diameter") >= F.col("v_diameter")))
    frontier = tree.filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    done = []
    for _ in range(rounds):
        p = frontier.join(side("u"), F.col("u") == F.col("u_node")).join(side("v"), F.col("v") == F.col("v_node"))
        if drop is not None:
            p = p.filter(~F.coalesce(drop(lower, upper), F.lit(False)))
        p = materialise(p.select("u", "v", "u_a", "u_b", "v_a", "v_b", F.col("u_n").alias("n_u"), F.col("v_n").alias("n_v"), apart.alias("separated"), lower.alias("lower"), ends.alias("ends"), split_u.alias("split_u")), "frontier")
        done.append(p.filter("ends").select("u", "v", "n_u", "n_v", "separated", "lower"))
        rest = p.filter("not ends")
        if rest.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        halves = lambda t: F.array_distinct(F.array(f"{t}_a", f"{t}_b"))
        stepped = rest.select(F.explode(F.when(F.col("split_u"), halves("u")).otherwise(halves("v"))).alias("x"), F.when(F.col("split_u"), F.col("v")).otherwise(F.col("u")).alias("y"))
        frontier = stepped.select(F.col("x").alias("u"), F.col("y").alias("v"))
    raise RuntimeError(f"the descent didn't end in {rounds} rounds")


def round_bound(tree: DataFrame, most: int) -> float:
    """The least weight that a pair of more than most points can have, infinity without such a pair. With a column
    comp in tree, pairs within one component don't count."""
    pairs = wspd(tree, mutual=True, drop=lambda lower, upper: (F.col("u_n") + F.col("v_n") <= most) | _joined(tree))
    least = pairs.agg(F.min("lower")).first()[0]
    return float("inf") if least is None else least


def _joined(tree: DataFrame) -> Column:
    return F.col("u_comp") == F.col("v_comp") if "comp" in tree.columns else F.lit(False)


def window_pairs(tree: DataFrame, low: float, high: float) -> DataFrame:
    """The pairs of the decomposition (in mutual reachability) that can hold a weight in [low, high), but for those
    within one component, if tree has a column comp (null where a node's points lie in several)."""
    return wspd(tree, mutual=True, drop=lambda lower, upper: (lower >= high) | (upper < low) | _joined(tree))


def _edges_of_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """The closest pair between separated sides; else the tree of the points of both."""
    x, cd, ids = np.stack(pdf["c"]), pdf["cd"].to_numpy(), pdf["id"].to_numpy()
    if not pdf["separated"].iloc[0]:
        return pd.DataFrame(dict(zip(("u", "v", "weight"), _prim(x, cd, ids))))
    left, right = np.flatnonzero(pdf["left"]), np.flatnonzero(~pdf["left"])
    best, step = [], max(1, HELD // len(right))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        w = np.maximum(np.maximum(distances(x[some], x[right]), cd[some, None]), cd[None, right])
        i, j = np.nonzero(w == w.min())
        a, b = ids[some[i]], ids[right[j]]
        best.append(min(zip(w[i, j].tolist(), np.minimum(a, b).tolist(), np.maximum(a, b).tolist())))
    w, u, v = min(best)
    return pd.DataFrame({"u": [u], "v": [v], "weight": [w]})


def window_edges(pairs: DataFrame, blocked: DataFrame, splits: Splits, low: float, high: float) -> DataFrame:
    """u, v, weight in [low, high): the closest points of each pair, for leaves that aren't separated the edges of
    their tree. blocked: points with cd and their leaf, block."""
    spark = blocked.sparkSession
    above = spark.createDataFrame([(k, node) for k, node, _ in _paths(splits)], "block int, node int")
    side = lambda node, left: F.struct(F.lit(left).alias("left"), F.col(node).alias("node"))
    ends = pairs.select("u", "v", "separated", F.explode(F.array(side("u", True), side("v", False))).alias("e"))
    rows = ends.select("u", "v", "separated", "e.left", "e.node").join(above, "node").join(blocked, "block")
    parts = tasks(spark, max(1, pairs.count()))
    found = rows.select("u", "v", "separated", "left", "id", "c", "cd").repartition(parts, "u", "v").groupBy("u", "v").applyInPandas(_edges_of_pair, EDGES)
    return found.filter((F.col("weight") >= low) & (F.col("weight") < high))


def tree_by_windows(points_cd: DataFrame, n: int, dims: int, block_size: int, most: int = 64, growth: int = 8) -> DataFrame:
    """A spanning tree in mutual reachability from points(id, c, cd): window by window of weights, each up to the
    bound of pairs of more than most points, which grows. Edges of equal weight may differ from mst's. The closest points of a pair are looked for in one
    task over all n_u * n_v; mst, which bounds its blocks, is the way for large inputs."""
    splits = fit_splits(points_cd, n, block_size)
    blocked = materialise(assign_blocks(points_cd, splits), "blocked")
    tree = box_tree(points_cd, n, dims, block_size, splits)
    own = blocked.withColumn("separated", F.lit(False))
    forest = materialise(kruskal(own.repartition(tasks(points_cd.sparkSession, max(1, tree.count())), "block").groupBy("block").applyInPandas(_edges_of_pair, EDGES)), "forest")
    above = points_cd.sparkSession.createDataFrame([(k, node) for k, node, _ in _paths(splits)], "block int, node int")
    low, edges = -1.0, forest.count()
    while edges < n - 1:
        known = materialise(blocked.join(components(forest, edges), "id", "left").groupBy("block").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count_if(F.col("comp").isNull()).alias("alone")), "known")
        marks = known.join(above, "block").groupBy("node").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.sum("alone").alias("alone"))
        marked = materialise(tree.join(marks.select("node", F.when((F.col("x") == F.col("y")) & (F.col("alone") == 0), F.col("x")).alias("comp")), "node"), "marked")
        high = round_bound(marked, most)
        pairs = materialise(window_pairs(marked, low, high), "pairs")
        forest = materialise(kruskal(forest.unionByName(window_edges(pairs, blocked, splits, low, high))), "forest")
        low, most, edges = high, most * growth, forest.count()
    return forest
