"""Sinks: manifests, model files, closure reports and content hashes, all written by Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_manifest(df: DataFrame, path: str, kind: str = "json", order: tuple[str, ...] = ()) -> None:
    """One row a record as json, csv or parquet; nested columns become JSON in csv. Sorted by `order` inside files of a range partition."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    if kind == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        df.write.option("header", "true").csv(path)
    elif kind in ("json", "parquet"):
        getattr(df.write, kind)(path)
    else:
        raise ValueError(f"unknown manifest kind {kind!r}")


def model_json(knots: DataFrame) -> DataFrame:
    """curve, model: one JSON document a curve with its knots in order."""
    k = F.transform(F.array_sort(F.collect_list(F.struct("knot", "x", "y"))), lambda r: F.struct(r["x"].alias("vds"), r["y"].alias("coss")))
    g = knots.groupBy("curve").agg(k.alias("knots"), F.first("scale").alias("v_scale"), F.max("achieved").alias("achieved"))
    return g.select("curve", F.to_json(F.struct("v_scale", "achieved", "knots")).alias("model"))


def closure_markdown(verdicts: DataFrame) -> DataFrame:
    """One row, report: a Markdown table of entities' verdicts, in order. Reports are read by people; keep them to small batches."""
    row = F.struct("entity", F.concat(F.lit("| "), F.col("entity").cast("string"), F.lit(" | "), "status", F.lit(" | "), "reasons", F.lit(" |")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n")
    return verdicts.agg(F.concat(F.lit("| entity | status | reasons |\n|-|-|-|\n"), body).alias("report"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def write_charge_csv(table: DataFrame, path: str) -> None:
    """curve, v, q, e of tabulated charges as csv, in order within a curve."""
    table.select("curve", "i", "v", "q", "e").repartitionByRange("curve").sortWithinPartitions("curve", "i").drop("i").write.mode("overwrite").option("header", "true").csv(path)
