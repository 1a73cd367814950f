"""A corpus pipeline of five stages. Each reads what its predecessor wrote; all but the last return the
columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkgrove.llm.bpe import encode_decode
from sparkgrove.llm.exact_dedup import drop_exact_copies
from sparkgrove.llm.language import keep_identified
from sparkgrove.llm.mixing import apply_mix
from sparkgrove.llm.near_dedup import drop_near_copies
from sparkgrove.llm.queries import tokenizer_path
from sparkgrove.session import shared_dir, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    ship(spark)
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    ship(spark)
    return drop_near_copies(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document taken."""
    ship(spark)
    return encode_decode(docs, tokenizer_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("tokens", tokens)]

#: Classifying, near copies and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
