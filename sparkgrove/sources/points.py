"""Readers that give points(id LONG, c ARRAY<DOUBLE>): dense ids from 0, finite, one length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("c", T.ArrayType(T.DoubleType()))])
MIN_DIM, MAX_DIM = 2, 20
DELIMITERS = r"[\t;, \r]+"
NUMBER_LINE = r"^[0-9.+\-eE\t;, \r]*$"


def check_dims(d: int, max_dim: int = MAX_DIM) -> int:
    if not MIN_DIM <= d <= max_dim:
        raise ValueError(f"points need {MIN_DIM} to {max_dim} dimensions, not {d}")
    return d


def validate(points: DataFrame, max_dim: int = MAX_DIM) -> tuple[DataFrame, int, int]:
    """(points, n, d). One aggregate job; raises ValueError on null, non-finite or ragged rows."""
    bad = F.col("id").isNull() | F.col("c").isNull() | F.exists("c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = points.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.min(F.size("c")).alias("lo"), F.max(F.size("c")).alias("hi")).first()
    if r.n == 0:
        raise ValueError("no points")
    if r.bad:
        raise ValueError(f"{r.bad} points have a null or non-finite coordinate")
    if r.lo != r.hi:
        raise ValueError(f"ragged rows: {r.lo} to {r.hi} coordinates")
    return points, r.n, check_dims(r.lo, max_dim)


def from_columns(df: DataFrame, coords: list[str | Column], key: str | None = None) -> DataFrame:
    """Points of some columns. With key, ids follow its order (0, 1, ...) and must not be null."""
    c = F.array(*[(F.col(x) if isinstance(x, str) else x).cast("double") for x in coords])
    if key is None:
        return dense_ids(df.select(c.alias("c")), [])
    return dense_ids(df.select(F.col(key).alias("_k"), c.alias("c")), ["_k"])


def dense_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """Number rows 0.. in the given order: a range sort, then an offset per partition; no single task."""
    spark = df.sparkSession
    placed = df.orderBy(*order) if order else df
    return spark.createDataFrame(placed.select("c").rdd.zipWithIndex().map(lambda x: (x[1], x[0].c)), POINTS)


def from_numpy(spark: SparkSession, array: np.ndarray, max_dim: int = MAX_DIM) -> DataFrame:
    """Rows of a 2-D array of any numeric type; ids are row numbers."""
    a = np.asarray(array)
    if a.ndim != 2:
        raise ValueError("a 2-D array is needed")
    check_dims(a.shape[1], max_dim)
    a = a.astype(np.float64)
    if not np.isfinite(a).all():
        raise ValueError("a coordinate is not finite")
    flat = pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(a))), "c": flat}), schema=POINTS)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def is_header(line: str) -> bool:
    return any(ch not in "0123456789.+-eE\t;, \r" for ch in line)


def count_fields(line: str) -> int:
    return len([x for x in line.replace("\t", " ").replace(";", " ").replace(",", " ").split() if x])


def infer_dims(spark: SparkSession, path: str) -> int:
    """Fields of line 1, or of line 2 when line 1 is a header."""
    head = [r.value for r in text_lines(spark, path).limit(2).collect()]
    if not head:
        raise ValueError(f"{path} is empty")
    line = head[1] if is_header(head[0]) and len(head) > 1 else head[0]
    return count_fields(line)


def read_points(spark: SparkSession, path: str, mode: str = "rows", max_dim: int = MAX_DIM) -> DataFrame:
    """Delimited text (tab ; , blank; repeats collapse), optional one-line header; ids in file order.

    mode='rows' raises ValueError on rows of another length; mode='flat' chunks the token stream by
    the inferred dimension and drops an incomplete tail.
    """
    d = check_dims(infer_dims(spark, path), max_dim)
    lines = text_lines(spark, path).rdd.zipWithIndex().map(lambda x: (x[1], x[0].value))
    df = spark.createDataFrame(lines, "line long, value string")
    header = (F.col("line") == 0) & ~F.col("value").rlike(NUMBER_LINE)
    tokens = F.filter(F.split(F.trim("value"), DELIMITERS), lambda x: x != "")
    df = df.filter(~header).select("line", tokens.alias("tok")).filter(F.size("tok") > 0)
    numbers = df.select("line", "tok", F.transform("tok", lambda x: x.try_cast("double")).alias("c"))
    bad = F.exists("c", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = numbers.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.size("c") != d).alias("ragged")).first()
    if r.n == 0:
        raise ValueError(f"{path} has no points")
    if r.bad:
        raise ValueError(f"{path}: {r.bad} lines hold something else than finite numbers")
    if mode == "rows":
        if r.ragged:
            raise ValueError(f"{path}: {r.ragged} lines don't have {d} fields")
        return dense_ids(numbers.select("line", "c"), ["line"])
    flat = numbers.orderBy("line").select(F.explode("c").alias("x")).rdd.zipWithIndex()
    flat = spark.createDataFrame(flat.map(lambda r: (r[1] // d, r[1] % d, r[0].x)), "id long, k int, x double")
    rows = flat.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"))
    return rows.filter(F.size("c") == d)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every token of a text file, in order: pos LONG, token STRING."""
    tokens = spark.read.text(path).select(F.explode(F.filter(F.split(F.trim("value"), DELIMITERS), lambda x: x != "")).alias("token"))
    return spark.createDataFrame(tokens.rdd.zipWithIndex().map(lambda x: (x[1], x[0].token)), "pos long, token string")


def read_int_sequence(spark: SparkSession, path: str, header: str = "sequenceInt") -> DataFrame:
    """Integers after a header token: pos LONG from 0, value LONG. ValueError without the header."""
    t = read_tokens(spark, path)
    first = t.filter("pos = 0").first()
    if first is None or first.token != header:
        raise ValueError(f"{path} doesn't begin with {header}")
    return t.filter("pos > 0").select((F.col("pos") - 1).alias("pos"), F.col("token").cast("long").alias("value"))


def synthetic_blobs(spark: SparkSession, n: int, centres: list[list[float]], spread: float = 1.0, seed: int = 0) -> DataFrame:
    """Gaussian blobs: row i belongs to centre i mod len(centres)."""
    d = check_dims(len(centres[0]))
    pick = F.pmod(F.col("id"), F.lit(len(centres)))
    mids = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    noise = F.array(*[F.randn(seed + k) * spread for k in range(d)])
    return spark.range(n).select("id", F.zip_with(F.element_at(mids, (pick + 1).cast("int")), noise, lambda m, e: m + e).alias("c"))
