"""From raw documents to a sharded training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routelens.llm.language_id import identified, learn
from routelens.llm.order_minhash import keep_one
from routelens.llm.range_shards import sharded
from routelens.llm.source_mix import mixed
from routelens.llm.tables import table, written
from routelens.llm.winnow import decontaminated


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, with a score of at least one half, stay."""
    return identified(docs, learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest doc_id."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources approach their target weights."""
    return mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard of about equal bytes and a place in it."""
    return sharded(docs)


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("shards", deal_shards),
]

ORACLE_SQL = None  # the learned language model and the near-duplicate classes have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
