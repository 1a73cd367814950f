"""Spatial blocks: the plan-time stand-in for an index. A sample fixes the splits, executors apply them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 100_000
MAX_BLOCKS = 4096


@dataclass(frozen=True)
class Splits:
    """A binary tree of (dimension, threshold); leaves are blocks. At most MAX_BLOCKS leaves."""

    dim: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.dim[node] >= 0)
        while len(live):
            k = node[live]
            below = x[live, self.dim[k]] < self.at[k]
            node[live] = np.where(below, self.left[k], self.right[k])
            live = live[self.dim[node[live]] >= 0]
        return node


def fit_splits(points: DataFrame, n: int, block_size: int) -> Splits:
    """Halve the widest side at the sample's median until a block holds about block_size points.
    The sample is bounded by SAMPLE_ROWS; it places the cuts only and never decides a result."""
    fraction = min(1.0, SAMPLE_ROWS / max(n, 1))
    rows = points.select("c") if fraction == 1.0 else points.select("c").sample(fraction, seed=7)
    x = np.array([r.c for r in rows.limit(2 * SAMPLE_ROWS).toLocalIterator()], np.float64)
    target = max(2.0, block_size * min(1.0, len(x) / max(n, 1)))
    dim, at, left, right = [-1], [0.0], [0], [0]
    todo, leaves = [(0, np.arange(len(x)))], 1
    while todo and leaves < MAX_BLOCKS:
        k, rows_in = todo.pop(0)
        if len(rows_in) <= target:
            continue
        part = x[rows_in]
        j = int(np.argmax(part.max(0) - part.min(0)))
        cut = float(np.median(part[:, j]))
        low = part[:, j] < cut
        if not low.any() or low.all():
            cut = float((part[:, j].min() + part[:, j].max()) / 2)
            low = part[:, j] < cut
            if not low.any() or low.all():
                continue
        dim[k], at[k], left[k], right[k] = j, cut, len(dim), len(dim) + 1
        for side in (rows_in[low], rows_in[~low]):
            todo.append((len(dim), side))
            dim.append(-1), at.append(0.0), left.append(0), right.append(0)
        leaves += 1
    return Splits(np.array(dim), np.array(at), np.array(left), np.array(right))


def assign_blocks(points: DataFrame, splits: Splits) -> DataFrame:
    """points plus block INT (a map over Arrow batches; no shuffle)."""
    schema = T.StructType([*points.schema.fields, T.StructField("block", T.IntegerType())])

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(block=splits.assign(np.stack(pdf["c"].to_numpy())).astype("int32"))

    return points.mapInPandas(place, schema)


def bounding_box(points: DataFrame, by: list[str] | None = None, dims: int | None = None) -> DataFrame:
    """lo, hi and n per group (or over all rows): min and max per coordinate, map-side combined."""
    d = dims or points.select(F.size("c")).first()[0]
    lo = F.array(*[F.min(F.col("c")[i]) for i in range(d)]).alias("lo")
    hi = F.array(*[F.max(F.col("c")[i]) for i in range(d)]).alias("hi")
    return points.groupBy(*(by or [])).agg(lo, hi, F.count("*").alias("n"))


def block_table(blocked: DataFrame, dims: int, core: bool = False) -> pd.DataFrame:
    """One row per block, on the driver: at most MAX_BLOCKS rows whatever the input."""
    aggs = [F.min("cd").alias("cd_min"), F.max("cd").alias("cd_max")] if core else []
    lo = F.array(*[F.min(F.col("c")[i]) for i in range(dims)]).alias("lo")
    hi = F.array(*[F.max(F.col("c")[i]) for i in range(dims)]).alias("hi")
    return blocked.groupBy("block").agg(lo, hi, F.count("*").alias("n"), *aggs).toPandas().sort_values("block", ignore_index=True)


def box_gaps(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Least distances between boxes 1 (rows) and 2 (columns), shaved to stay lower bounds in floating point."""
    acc = np.zeros((len(lo1), len(lo2)))
    for j in range(lo1.shape[1]):
        g = np.maximum(np.maximum(lo1[:, j, None] - hi2[None, :, j], lo2[None, :, j] - hi1[:, j, None]), 0.0)
        acc += g * g
    return np.sqrt(acc) * (1.0 - 1e-12)
