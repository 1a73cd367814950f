"""A filter of fixed size in front of a join: rows that surely have no partner aren't shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in the filter: the broadcast has at most so many rows, whatever the input.
WORDS = 1 << 17


def _place(h: Column) -> tuple[Column, Column]:
    return F.pmod(h, F.lit(WORDS)).cast("int"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")


def split(rows: DataFrame, h: Column, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be members, rows that surely aren't), by one bit for each hash of members (one LONG
    column; h is the same hash of a row). The larger members is, the more rows may be members: that costs
    shuffle, never rows. A null hash is no member."""
    word, bit = _place(F.col(members.columns[0]))
    words = members.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_b")).groupBy("_word").agg(F.bit_or("_b").alias("_bits"))
    word, bit = _place(h)
    looked = rows.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    hit = F.coalesce(F.getbit("_bits", "_bit") == 1, F.lit(False))
    return looked.filter(hit).select(*rows.columns), looked.filter(~hit).select(*rows.columns)
