"""python -m sparkgrove [-m minPts] [-r rounds] [-p] file"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkgrove.functions.vector import perturb
from sparkgrove.operators.dendrogram import dendrogram
from sparkgrove.plans.hierarchy import density_tree
from sparkgrove.session import materialise
from sparkgrove.sources.points import read_points
from sparkgrove.sources.sinks import numbers_text, write_sequence


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkgrove", description="density hierarchy of a point file")
    p.add_argument("-m", dest="min_pts", type=int, default=1)
    p.add_argument("-r", dest="rounds", type=int, default=1)
    p.add_argument("-p", dest="perturb", type=int, default=0)
    p.add_argument("-o", dest="out", default=None)
    p.add_argument("file")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sparkgrove").getOrCreate()
    points = read_points(spark, a.file)
    if a.perturb:
        points = points.select("id", perturb("c", "id").alias("c"))
    points = materialise(points, "points")
    n = points.count()
    for k in range(a.rounds):
        timings: dict[str, float] = {}
        rounds: list[dict[str, float]] = []
        began = time.perf_counter()
        tree = materialise(density_tree(points, a.min_pts, timings=timings, rounds=rounds), "tree")
        for r in rounds:
            print({name: round(s, 6) for name, s in r.items()})
        merging = time.perf_counter()
        merges = dendrogram(tree, n)
        if a.out and k == 0:
            line = F.concat_ws(" ", "left", "right", numbers_text(F.array("height")), "size")
            write_sequence(merges.withColumn("line", line), a.out, "line", "merge_idx")
        else:
            merges.count()
        timings["dendrogram"] = time.perf_counter() - merging
        print({name: round(s, 3) for name, s in timings.items()}, f"total {time.perf_counter() - began:.3f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
