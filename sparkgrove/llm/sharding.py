"""Sharding by a hierarchical weighted hash tree. Native.

A tree of regions, racks and shards carries weights; a document descends it, at each level to the child
with the least -ln(u) / weight, u hashed from (doc_id, child). A child's weight change moves documents
between that child and its siblings only. A new shard is added as a region of its own (one rack, one
shard), so growth takes documents only into the new shard.

Cases: a null doc_id hashes as its own value; repeated rows land in one shard, each with a slot; null
text has size 1 and the checksum of the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkgrove.llm.mixing import draw

#: Slots are numbered in this many parts of a shard at once.
PARTS = 64

Tree = tuple[tuple[tuple[tuple[int, float], ...], ...], ...]  # regions of racks of (shard, weight)


@dataclass(frozen=True)
class Topology:
    tree: Tree

    @classmethod
    def even(cls, shards: int = 16, regions: int = 2, racks: int = 2) -> Topology:
        """Equal weights; shards dealt to regions x racks in order."""
        if shards % (regions * racks):
            raise ValueError("shards must divide evenly into racks; add more by grown()")
        per = shards // (regions * racks)
        ids = iter(range(shards))
        return cls(tuple(tuple(tuple((next(ids), 1.0) for _ in range(per)) for _ in range(racks)) for _ in range(regions)))

    @property
    def size(self) -> int:
        return sum(len(rack) for region in self.tree for rack in region)

    def grown(self, weight: float = 1.0) -> Topology:
        return Topology((*self.tree, (((self.size, weight),),)))


def _pick(doc_id: Column, level: str, names: list[str], weights: list[float]) -> Column:
    """Index of the child with the least -ln(u) / weight."""
    if len(names) == 1:
        return F.lit(0)
    scores = []
    for i, (name, w) in enumerate(zip(names, weights)):
        scores.append(F.struct((-F.ln(draw(doc_id, f"{level}/{name}")) / w).alias("s"), F.lit(i).alias("i")))
    return F.least(*scores)["i"]


def assign(doc_id: Column, topology: Topology) -> Column:
    """The shard of a document: depends on its id and the topology alone."""
    regions = topology.tree
    region = _pick(doc_id, "region", [str(i) for i in range(len(regions))], [sum(w for rack in r for _, w in rack) for r in regions])
    out = None
    for i, racks in enumerate(regions):
        rack = _pick(doc_id, f"rack{i}", [str(j) for j in range(len(racks))], [sum(w for _, w in k) for k in racks])
        leaf = None
        for j, shards in enumerate(racks):
            pick = _pick(doc_id, f"shard{i}.{j}", [str(s) for s, _ in shards], [w for _, w in shards])
            shard = F.element_at(F.array(*[F.lit(s) for s, _ in shards]), pick + 1)
            leaf = F.when(rack == j, shard) if leaf is None else leaf.when(rack == j, shard)
        out = F.when(region == i, leaf) if out is None else out.when(region == i, leaf)
    return out.cast("int")


def shard(docs: DataFrame, topology: Topology | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots run from 0 without gaps in each shard: counts per (shard, part) from a scan of the ids alone
    give each part's first slot, and rows are numbered within parts.
    """
    topology = topology or Topology.even()
    doc = F.col("doc_id")
    part = F.floor(draw(doc, "part") * PARTS).cast("int")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    counts = ids.select(assign(doc, topology).alias("shard"), part.alias("part")).groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(first, F.lit(0)).alias("start"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({"shard": assign(doc, topology), "grown_shard": assign(doc, topology.grown()), "part": part})
    place = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("place", place)
    # at most shards x PARTS rows: small whatever the input
    out = numbered.join(F.broadcast(starts), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard")
