"""Text writers for points, edges and sequences. Row order in a file follows the given key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = "%.11e"


def numbers_text(c: Column) -> Column:
    """The numbers of an array, blank separated; null if one is. By Python, which rounds a double's exact value, as
    C does: Java's %e rounds the shortest decimal that reads back as the double, halves up."""

    @F.pandas_udf("string")
    def text(c: pd.Series) -> pd.Series:
        return c.map(lambda a: None if a is None or any(x is None or x != x for x in a) else " ".join(NUMBER % x for x in a)).astype(object)

    return text(c)


def point_lines(points: DataFrame) -> DataFrame:
    return points.select("id", numbers_text(F.col("c")).alias("value"))


def edge_lines(edges: DataFrame, weighted: bool = True) -> DataFrame:
    if weighted:
        return edges.select("u", "v", F.concat_ws(" ", "u", "v", numbers_text(F.array("weight"))).alias("value"))
    return edges.select("u", "v", F.format_string("%d %d", "u", "v").alias("value"))


def write_points(points: DataFrame, path: str) -> None:
    """One point a line, blank separated, range-sorted by id across part files."""
    point_lines(points).orderBy("id").select("value").write.text(path)


def _with_header(lines: DataFrame, header: str, order: list[str]) -> DataFrame:
    """One file with a header line in front: the layout that single-file readers of the format expect."""
    head = lines.limit(0).select("value", *order).unionByName(lines.sparkSession.createDataFrame([(header,)], "value string"), allowMissingColumns=True)
    both = head.withColumn("_h", F.lit(0)).unionByName(lines.select("value", *order, F.lit(1).alias("_h")))
    return both.repartition(1).sortWithinPartitions("_h", *order).select("value")


def write_points_with_header(points: DataFrame, path: str, dims: int) -> None:
    if not 2 <= dims <= 9:
        raise ValueError("the header form exists for 2 to 9 dimensions")
    _with_header(point_lines(points), f"pbbs_sequencePoint{dims}d", ["id"]).write.text(path)


def write_edges(edges: DataFrame, path: str, weighted: bool = True) -> None:
    edge_lines(edges, weighted).orderBy("u", "v").select("value").write.text(path)


def write_sequence(df: DataFrame, path: str, column: str, order: str, header: str | None = None) -> None:
    lines = df.select(F.col(order).alias("_o"), F.col(column).cast("string").alias("value"))
    if header is None:
        lines.orderBy("_o").select("value").write.text(path)
    else:
        _with_header(lines, header, ["_o"]).write.text(path)


def write_int_sequence(df: DataFrame, path: str, column: str = "value", order: str = "pos") -> None:
    write_sequence(df, path, column, order, "sequenceInt")


def write_two_sequences(a: DataFrame, b: DataFrame, path: str, column: str, order: str) -> None:
    """The rows of a, then those of b."""
    both = a.select(F.lit(0).alias("_s"), F.col(order).alias("_o"), F.col(column).cast("string").alias("value")).unionByName(
        b.select(F.lit(1).alias("_s"), F.col(order).alias("_o"), F.col(column).cast("string").alias("value"))
    )
    both.orderBy("_s", "_o").select("value").write.text(path)
