"""Mixing sources to target weights by Pareto order sampling. Native.

Each source's target is its weight's share of all words, at most `most` times its own words, the excess
reshared by weight. Every document is first given the whole copies its rate floor(r) makes certain; one
further copy of some documents is drawn by Pareto order sampling: documents are ranked by random odds
over inclusion odds, (u / (1-u)) / (f / (1-f)) with f the fraction of r, and the lowest ranks are taken
until the source's words are met.

Cases: null or blank text has size 0 and takes 0 words; a null source is a source of its own, last in
order; a source without words has target 0; the draw depends on doc_id only (a null id draws too), so
reruns agree; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int | str) -> Column:
    """A uniform number in (0, 1) by hash of the id: 48 bits of md5."""
    h = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target. One row per source; the order and the level run over sources only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most)
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    per = per.withColumns({"rest": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    per = per.withColumn("capped", F.col("cap") * F.col("rest_w") <= F.col("w") * F.col("rest"))
    # of the sources that aren't capped the first in order has the largest rest per weight: that is the level
    level = F.max(F.when(~F.col("capped"), F.col("rest") / F.col("rest_w"))).over(everything)
    return per.withColumn("level", level).select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def _with_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    per = per.withColumnRenamed("source", "_s")
    return rows.join(per, rows["source"].eqNullSafe(per["_s"])).drop("_s")


def _rated(rows: DataFrame, goal: DataFrame, most: int, seed: int) -> DataFrame:
    """rows(doc_id, source, size, tilt, ...) with their rate, whole copies, rank of the draw and its bin."""
    rate = F.when(F.col("mass") > 0, F.least(F.lit(float(most)), F.col("target") * F.col("tilt") / F.col("mass"))).otherwise(F.lit(0.0))
    r = _with_source(rows, goal).withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    f = F.col("rate") - F.col("whole")
    u = draw(F.col("doc_id"), seed)
    # q / (1 + q) for q = (u / (1-u)) / (f / (1-f)): the same order, within [0, 1]
    rank = F.when(f > 0, u * (1.0 - f) / (u * (1.0 - f) + (1.0 - u) * f)).when(F.col("rate") < most, F.lit(1.0))
    return r.withColumn("rank", rank).withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)))


def _base(docs: DataFrame, weight_col: str | None, text_col: str, id_col: str, source_col: str) -> list[Column]:
    tilt = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.when(F.isnan(tilt), F.lit(0.0)).otherwise(tilt).alias("tilt")]


def _drawn(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, weight_col: str | None, text_col: str, id_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(goals per source, cuts per source, rated rows with their cut; those of the cut's bin have extra).

    Shuffles: sums per source, sums per (source, bin); only the bin that holds a source's cut is ranked row by row.
    """
    base = materialise(docs.select(*_base(docs, weight_col, text_col, id_col, source_col)), "sizes")
    goal = targets(base, weights, most)
    if weight_col is None:
        goal = goal.withColumn("mass", F.col("source_size").cast("double"))
    else:
        mass = base.groupBy("source").agg(F.sum(F.col("tilt") * F.col("size")).alias("mass")).withColumnRenamed("source", "s2")
        goal = goal.join(mass, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    goal = materialise(goal, "targets")
    r = _rated(base, goal, most, seed)
    bins = r.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target"))
    total = W.partitionBy("source")
    run = total.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("need", F.col("target") - F.sum("sure").over(total)).filter("bin is not null").withColumn("upto", F.sum("words").over(run))
    cuts = bins.groupBy("source").agg(F.min(F.when(F.col("upto") >= F.col("need"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("cut"), F.first("need").alias("need"))
    cuts = materialise(cuts, "cuts").select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"), "need")
    r = _with_source(r, cuts)
    inside = r.filter(F.col("bin") == F.col("cut_bin"))
    upto = F.sum("size").over(total.orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    inside = inside.withColumn("upto", upto)
    short = F.col("need") - (F.col("upto") - F.col("size"))
    inside = inside.withColumn("extra", ((short > 0) & (F.col("upto") - F.col("need") <= short)).cast("long")).drop("upto")
    outside = r.filter(~F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False)))
    outside = outside.withColumn("extra", (F.col("rank").isNotNull() & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")))).cast("long"))
    return goal, cuts, inside.unionByName(outside)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, weight_col: str | None = None, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row.

    weight_col tilts the rates within a source (null, NaN or negative counts as 0).
    """
    rows = _drawn(docs, weights, most, seed, weight_col, text_col, id_col, source_col)[2]
    all_rows = rows.withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int"))
    return all_rows.select("doc_id", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, weight_col: str | None = None, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as often as the mix takes it, with all its columns. Rows that agree in
    id, source and size are taken alike (as often as the most taken of them).

    The last row that each source's cut takes decides for all rows: texts are not shuffled, as long as the
    table of sources is small enough to broadcast.
    """
    goal, cuts, rows = _drawn(docs, weights, most, seed, weight_col, text_col, id_col, source_col)
    place = F.struct("rank", "doc_id", "size")
    last = rows.filter((F.col("bin") == F.col("cut_bin")) & (F.col("extra") == 1)).groupBy("source").agg(F.max(place).alias("last")).withColumnRenamed("source", "s2")
    per = materialise(cuts.join(last, F.col("source").eqNullSafe(F.col("s2")), "left").select("source", "cut_bin", "last"), "lasts").withColumnRenamed("source", "s2")
    whole = docs.select(F.struct(*docs.columns).alias("row"), *_base(docs, weight_col, text_col, id_col, source_col))
    r = _rated(whole, goal, most, seed)
    r = r.join(per, r["source"].eqNullSafe(per["s2"]), "left")
    taken = F.when(F.col("rank").isNull(), False).when(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")), True).otherwise((F.col("bin") == F.col("cut_bin")) & F.coalesce(place <= F.col("last"), F.lit(False)))
    copies = (F.col("whole") + taken.cast("long")).cast("int")
    return r.withColumn("copies", copies).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
