"""Exact dedup: content hash, smallest stable row kept, bytes compared inside groups. Native.

One scan gives every row's 128-bit content hash; rows are then hashes and ids only. The bytes of those
texts alone whose hash occurs again are grouped by (hash, bytes): counts combine map-side, whatever a
group's size. Groups that hold a thousandth of all rows or more, so a thousand at most, join by broadcast.

Cases: a null text counts as empty; texts equal after deleting the characters [\\x20\\x09-\\x0D] form a
group; the row with the most code points stays, then the smallest doc_id (null ids last); of wholly
repeated rows (same id and text length) one stays; an empty table gives an empty result; columns other
than id and text are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrove.llm.membership import split
from sparkgrove.session import materialise

#: (code points, id) packed into one decimal, so that hash aggregation keeps a fixed-width maximum.
_STEP, _TOP = Decimal(10) ** 20, Decimal(10) ** 19
#: Groups of at least this share of all rows are joined by broadcast: there are at most 1 / HOT of them.
HOT = 0.001


def normalised(text: Column) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), " \n\t\r\x0b\x0c", F.coalesce(text, F.lit("")))


def _rank(length: Column, doc_id: Column) -> Column:
    low = F.coalesce(F.lit(_TOP) - doc_id.cast("decimal(20,0)"), F.lit(Decimal(0)))
    return (length.cast("decimal(10,0)") * F.lit(_STEP) + low).cast("decimal(38,0)")


def _texts(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("len"), normalised(F.col(text_col)).alias("norm"), row_hash(F.col(text_col), F.col(id_col)).alias("row"))
    return base.withColumn("key", F.unhex(F.md5("norm")))


def row_hash(text: Column, doc_id: Column) -> Column:
    """128 bits that name a row by its id and original text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, len, row, key (128-bit content hash), sha of every row."""
    return _texts(docs, text_col, id_col).select("doc_id", "len", "row", "key", F.unhex(F.sha2("norm", 256)).alias("sha"))


def groups(docs: DataFrame, prints: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per distinct text that may occur again: key, sha, keep_id, keep_len, group_size.

    The grouping key holds the bytes beside their hash, so equal hashes of different bytes stay apart. Two
    different texts that agreed in both hashes raise an error instead of merging.
    """
    again = prints.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("key").alias("h"))
    texts, _ = split(_texts(docs, text_col, id_col).select("doc_id", "len", "norm", "key"), F.xxhash64("key"), again)
    per_text = texts.groupBy("key", "norm").agg(F.count("*").alias("group_size"), F.max(_rank(F.col("len"), F.col("doc_id"))).alias("best"))
    slim = per_text.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", "best")
    one = slim.groupBy("key", "sha").agg(F.sum("group_size").alias("group_size"), F.max("best").alias("best"), F.count("*").alias("texts"))
    low = F.col("best") % F.lit(_STEP)
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts share both content hashes"))).otherwise(F.col("group_size"))
    return one.select("key", "sha", checked.cast("long").alias("group_size"), F.when(low > 0, (F.lit(_TOP) - low).cast("long")).alias("keep_id"), F.floor((F.col("best") - low) / F.lit(_STEP)).cast("int").alias("keep_len"))


def decisions(docs: DataFrame, prints: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per distinct (doc_id, len, key, sha): with copies (rows like it), row (the least of their
    hashes), keep_id, group_size, best (whether the row that stays is one of them)."""
    rows = prints.groupBy("doc_id", "len", "key", "sha").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    found = materialise(groups(docs, prints, text_col, id_col), "groups").filter("group_size > 1")
    large = F.col("group_size") >= max(2, HOT * prints.count())
    hot = F.broadcast(found.filter(large))  # at most 1 / HOT rows
    easy = rows.join(hot, ["key", "sha"])
    rest = rows.join(hot.select("key", "sha"), ["key", "sha"], "left_anti").join(found.filter(~large), ["key", "sha"], "left")
    alone = F.col("group_size").isNull()
    both = easy.unionByName(rest)
    best = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")))
    return both.select("doc_id", "sha", "row", "copies", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), best.alias("best"))


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    prints = materialise(fingerprints(docs, text_col, id_col), "prints")
    d = decisions(docs, prints, text_col, id_col)
    out = d.select("doc_id", "keep_id", "group_size", "best", F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns. Decided on hashes and ids: the rows shuffled are
    those that may go. Of rows that repeat id and text, one stays."""
    prints = materialise(fingerprints(docs, text_col, id_col), "prints")
    stay = decisions(docs, prints, text_col, id_col).filter("best").select("row", F.lit(True).alias("stays"))
    per_row = prints.groupBy("row").agg(F.count("*").alias("n")).join(stay, "row", "left")
    doubt = materialise(per_row.filter("n > 1 or stays is null").select(F.col("row").alias("_row"), F.coalesce("stays", F.lit(False)).alias("_stays")), "doubt")
    columns = docs.columns
    named = docs.select(F.struct(*columns).alias("whole"), row_hash(F.col(text_col), F.col(id_col)).alias("_name"))
    maybe, sure = split(named, F.xxhash64("_name"), doubt.select(F.xxhash64("_row")))
    held = maybe.join(doubt, maybe["_name"] == doubt["_row"], "left")
    one = held.filter("_stays").groupBy("_name").agg(F.any_value("whole").alias("whole"))
    return sure.select("whole.*").unionByName(held.filter("_stays is null").select("whole.*")).unionByName(one.select("whole.*"))
