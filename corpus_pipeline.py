"""The corpus pipeline: five stages from raw documents to sharded training data.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next one. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import decontaminate, jaccard, mixing, quality, sharding
from revlens.llm.queries import SHARDS, TARGET
from revlens.llm.store import ship, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep.

    A null text has no words and goes; an empty table gives an empty
    result; columns of any name are kept.
    """
    ship(spark)
    return quality.keep(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id.

    Rows are known by a 64-bit hash of id and text, so another text under the
    same id is a document of its own; rows that repeat both stay together.
    Rows without an id stay; an empty table gives an empty result; columns of
    any name are kept.
    """
    ship(spark)
    mark = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("mark")
    marked = docs.select(F.struct(*docs.columns).alias("row"), mark)
    groups = jaccard.similar_sets(docs.select(mark.alias("doc_id"), "text"), k=5, num=80, den=100)
    groups = groups.select(F.col("doc_id").alias("mark"), F.col("component_id").alias("top")).distinct()
    named = stored(groups.join(docs.select("doc_id", mark).distinct(), "mark"), "groups")
    first = named.groupBy("top").agg(F.min(F.struct("doc_id", "mark")).alias("first")).select("first.mark")
    gone = named.join(first, "mark", "left_anti").select("mark")  # by the row, not by the group: no group is a hot key
    return marked.join(gone, "mark", "left_anti").select("row.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows without an id or text stay; an empty table gives an empty
    result; columns of any name are kept.
    """
    ship(spark)
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken to meet the target weights, once for each time they are taken.

    Rows without an id are placed by their text; an empty table gives an
    empty result; columns of any name are kept.
    """
    ship(spark)
    held = docs.select(F.struct(*docs.columns).alias("document"), "doc_id", "text", "source")
    return mixing.mix(held, TARGET).select("document.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard.

    Rows without an id are placed by their text.
    """
    ship(spark)
    return sharding.place(docs, SHARDS)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_leaks),
          ("mixing", mixture), ("sharding", shards)]

#: No SQL twin: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
