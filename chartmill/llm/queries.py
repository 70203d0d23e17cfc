"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_subword import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid_crf import identify

    return identify(_documents(spark, sf_dir))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_documents(spark, sf_dir))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_kmtree import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .parity_join import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing_gga import pack

    return pack(_documents(spark, sf_dir), capacity=2048)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .shard_shuffle import shard

    out = shard(_documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest

    return digest(_documents(spark, sf_dir), window=400, words=51)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mcd import judge

    return judge(_documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pareto_mix import mix

    from pyspark.sql import functions as F

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
