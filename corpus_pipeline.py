"""Corpus pipeline: five stages, each a call of one operator of ``tillspark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet to the shared folder and read again as the next stage's ``docs``.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import decontaminate, langid, mixing, sharding, simhash
from tillspark.llm.common import scratch_table

SHARDS = 40


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language go (null texts, texts without a letter)."""
    found = langid.identify_language(docs)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one_per_component(docs).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark_contaminated(docs, bench).where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it (0 to 3 times)."""
    mixed = mixing.mix_sources(docs)
    return mixed.where(F.col("copies") > 0).withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard and slot; ``docs`` is read straight from Parquet files."""
    return sharding.shard_rows(docs, SHARDS, pinned=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_benchmark_passages),
    ("mix", mix_sources),
    ("shard", shard),
]

#: language identification has no SQL form; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir))
    return docs
