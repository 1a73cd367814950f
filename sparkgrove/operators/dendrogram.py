"""The merge tree of a spanning tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGES = "merge_idx long, left long, right long, height double, size long"


def dendrogram(edges: DataFrame, n: int) -> DataFrame:
    """merge_idx, left, right, height, size from the n - 1 edges of a tree over ids 0..n-1.

    Leaves are 0..n-1, merge i makes n + i; left is the cluster of the smaller endpoint. Merging is an
    ordered fold: one task, O(n) numbers. ValueError unless the edges form a tree.
    """
    count = edges.count()
    if count != n - 1:
        raise ValueError(f"{count} edges don't make a tree of {n} points")

    def fold(batches):
        up = np.arange(n)
        name, size = np.arange(n), np.ones(n, np.int64)
        i = 0
        for pdf in batches:
            rows = []
            for u, v, w in zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["weight"].tolist()):
                if not 0 <= u < v < n:
                    raise ValueError(f"edge ({u}, {v}) isn't between points 0 to {n - 1}")
                a, b = u, v
                while up[a] != a:
                    up[a] = a = up[up[a]]
                while up[b] != b:
                    up[b] = b = up[up[b]]
                if a == b:
                    raise ValueError(f"edge ({u}, {v}) closes a cycle")
                total = size[a] + size[b]
                rows.append((i, name[a], name[b], w, total))
                if size[a] < size[b]:
                    a, b = b, a
                up[b], size[a], name[a] = a, total, n + i
                i += 1
            yield pd.DataFrame(rows, columns=["merge_idx", "left", "right", "height", "size"])

    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight")
    return e.repartition(1).sortWithinPartitions("weight", "u", "v").mapInPandas(fold, MERGES)
