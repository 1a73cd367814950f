"""Connected components of an edge list, in DataFrame rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgrove.session import materialise

EDGES = "u long, v long"
#: Nodes that a task remembers; beyond, it hands on what it has and starts anew.
NODES = 300_000


def contract(edges: DataFrame) -> DataFrame:
    """Each task's edges as forests (v, root) of bounded size: the same components from fewer edges."""

    def forest(batches):
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (p := up.get(root, root)) != root:
                root = p
            while x != root:
                up[x], x = root, up.get(x, x)
            return root

        def rows() -> pd.DataFrame:
            nodes = list(up)
            return pd.DataFrame({"u": nodes, "v": [find(x) for x in nodes]}, dtype="int64")

        for pdf in batches:
            for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
                a, b = find(u), find(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > NODES:
                yield rows()
                up.clear()
        yield rows()

    return edges.select("u", "v").mapInPandas(forest, EDGES).filter("u <> v")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: every larger neighbour of u is tied to u's least neighbour; small star: the smaller ones
    and u itself. The least neighbour is an aggregate joined back, so a hub is no single task's group."""
    if small:
        toward = edges
    else:
        toward = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = toward.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    tied = toward.join(least, toward["u"] == least["c"])
    if small:
        rows = tied.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    else:
        rows = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rows.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp (the least node reachable) of every node with an edge.

    Alternating large and small stars until nothing changes; each round is written to the shared folder,
    so a lost executor costs at most a round.
    """
    e = materialise(contract(edges).distinct(), "links")
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        seen = mark
        e = materialise(_star(_star(e, small=False), small=True), "links")
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
