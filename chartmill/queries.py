"""Queries of the library's own operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import axis_queries, curve_queries, geometry_queries, match_queries, model_queries, panel_queries, text_queries

MODULES = [curve_queries, axis_queries, text_queries, match_queries, model_queries, geometry_queries, panel_queries]


def registered() -> dict[str, tuple]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registered()["curve_charge"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for name, q in registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for name, q in registered().items() if q[1]}
