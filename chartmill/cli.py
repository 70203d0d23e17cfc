"""Commands over folders of tables: each reads with Spark, writes what it finds, and says by its exit code whether all went well.

    python -m chartmill.cli export-coss-spice --points DIR --out DIR [--vmax V] [--samples N]
    python -m chartmill.cli anchors --tables DIR --out DIR
    python -m chartmill.cli cluster-layouts --pages DIR --out DIR [--threshold T] [--max-pdfs N] [--fail-on-errors]
    python -m chartmill.cli find --captions DIR --out DIR
    python -m chartmill.cli digitize-transfer --points DIR --pivots DIR --out DIR

What needs a PDF or a raster is read by other tools into the tables that these commands take.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import aggregate as G
from .operators import curves as C
from .operators import models as M
from .operators.anchors import capacitance_anchors
from .sources import sinks
from .sources.files import spec_rows


def export_coss_spice(spark: SparkSession, a: argparse.Namespace) -> int:
    """points (curve, x, y) -> netlists, models and charges; 1 if a curve was refused."""
    raw = spark.read.parquet(a.points).select(F.col("curve").cast("long").alias("curve"), "trace", "x", "y", "seq")
    status = C.refused_curves(raw)
    knots = M.adaptive_knots(C.clean_points(raw).select("curve", "x", "y"))
    table = M.charge_table(knots, a.vmax, a.samples)
    M.spice_text(table).write.mode("overwrite").json(f"{a.out}/netlists")
    sinks.model_json(knots).write.mode("overwrite").json(f"{a.out}/models")
    sinks.write_charge_csv(table, f"{a.out}/charges")
    status.write.mode("overwrite").json(f"{a.out}/status")
    return int(bool(status.where("status <> 'ok'").limit(1).count()))


def anchors(spark: SparkSession, a: argparse.Namespace) -> int:
    """Specification tables -> anchors by part; 1 if no part has any."""
    found = capacitance_anchors(spec_rows(spark, a.tables).select("part", F.col("line_no").alias("line"), "cells"))
    found.write.mode("overwrite").json(f"{a.out}/anchors")
    return int(not spark.read.schema(found.schema).json(f"{a.out}/anchors").limit(1).count())


def cluster_layouts(spark: SparkSession, a: argparse.Namespace) -> int:
    """pages (id, pdf, role, mode, tokens) -> clusters; 1 with --fail-on-errors if a page has no tokens. --max-pdfs takes the first documents in order."""
    pages = spark.read.parquet(a.pages)
    if a.max_pdfs:
        first = pages.select("pdf").distinct().orderBy("pdf").limit(a.max_pdfs)
        pages = pages.join(F.broadcast(first), "pdf", "left_semi")  # at most --max-pdfs names
    bad = pages.where(F.size(F.coalesce("tokens", F.array().cast("array<string>"))) == 0)
    good = pages.where(F.size("tokens") > 0)
    keyed = good.select(F.concat_ws("|", "role", "mode").alias("coarse"), "id", G.fingerprint(F.col("tokens")).alias("fingerprint"), "tokens")
    M.cluster_layouts(keyed, a.threshold).write.mode("overwrite").json(f"{a.out}/clusters")
    bad.select("id", F.lit("no tokens").alias("error")).write.mode("overwrite").json(f"{a.out}/errors")
    return int(a.fail_on_errors and bool(bad.limit(1).count()))


def find(spark: SparkSession, a: argparse.Namespace) -> int:
    """captions (id, title, text) -> kinds of charts; errors are written, not raised."""
    c = spark.read.parquet(a.captions)
    rows = c.select("id", T.chart_kind(F.col("title"), F.col("text")).alias("kind"), T.figure_number(F.col("title")).alias("figure"), T.is_spec_header(F.col("title")).alias("spec_header"), F.when(F.col("title").isNull(), "no title").alias("error"))
    rows.write.mode("overwrite").json(f"{a.out}/panels")
    return 0


def digitize_transfer(spark: SparkSession, a: argparse.Namespace) -> int:
    """points (curve, v, i), pivots (curve, vpl, id_pl) -> fits; 1 if none is ok."""
    got = G.pivot_vth(spark.read.parquet(a.points), spark.read.parquet(a.pivots))
    got.write.mode("overwrite").json(f"{a.out}/fits")
    return int(not spark.read.schema(got.schema).json(f"{a.out}/fits").where("status = 'ok'").limit(1).count())


COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], int], list[str]]] = {
    "export-coss-spice": (export_coss_spice, ["points"]),
    "anchors": (anchors, ["tables"]),
    "cluster-layouts": (cluster_layouts, ["pages"]),
    "find": (find, ["captions"]),
    "digitize-transfer": (digitize_transfer, ["points", "pivots"]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chartmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, inputs) in COMMANDS.items():
        p = commands.add_parser(name)
        for i in [*inputs, "out"]:
            p.add_argument(f"--{i}", required=True)
        if name == "export-coss-spice":
            p.add_argument("--vmax", type=float, default=400.0)
            p.add_argument("--samples", type=int, default=256)
        if name == "cluster-layouts":
            p.add_argument("--threshold", type=float, default=0.72)
            p.add_argument("--max-pdfs", type=int, default=0)
            p.add_argument("--fail-on-errors", action="store_true")
    a = parser.parse_args(argv)
    return COMMANDS[a.command][0](spark or SparkSession.builder.appName(f"chartmill-{a.command}").getOrCreate(), a)


if __name__ == "__main__":
    raise SystemExit(main())
