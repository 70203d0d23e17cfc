"""Adapters that give the driver's tables the shapes of the operators, each in DataFrame form and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: 2024-01-01 in microseconds: abscissae count hours from here.
EPOCH = 1_704_067_200_000_000


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as curve points: a user is a curve, hours are x, the value is y."""
    e = table(spark, sf_dir, "events")
    x = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH) / F.lit(3.6e9)
    return e.select(F.col("user_id").alias("curve"), F.col("event_type").alias("trace"), x.alias("x"), F.col("value").alias("y"), F.col("event_id").alias("seq"))


POINTS = f"pts AS (SELECT user_id AS curve, event_type AS trace, (epoch_us(ts) - {EPOCH}) / 3600000000.0 AS x, value AS y, event_id AS seq FROM events)"
CLEAN = POINTS + """, merged AS (SELECT curve, round(greatest(x, 0), 10) AS x, median(y) AS y FROM pts WHERE isfinite(x) AND isfinite(y) AND y > 0 GROUP BY 1, 2),
 cl AS (SELECT * FROM merged QUALIFY count(*) OVER (PARTITION BY curve) >= 2)"""
STEPS = CLEAN + """, st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, x - lag(x) OVER w AS dx, row_number() OVER w AS i, count(*) OVER (PARTITION BY curve) AS n FROM cl WINDOW w AS (PARTITION BY curve ORDER BY x))"""


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as axis ticks: an order is an axis, the line number a pixel row, quantity the printed value."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("axis"), (F.col("l_linenumber") * 40.0).alias("pixel"), F.col("l_quantity").alias("value"))


TICKS = "ticks AS (SELECT l_orderkey AS axis, CAST(l_linenumber * 40 AS DOUBLE) AS pixel, l_quantity AS value FROM lineitem)"


def box_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as boxes on pages: page, id, x0, y0, x1, y1."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    x0, y0 = (k * 37) % 500, (k * 53) % 700
    return p.select(F.floor(k / 50).alias("page"), k.alias("id"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 40 + F.col("p_size")).cast("double").alias("x1"), (y0 + 30 + 2 * F.col("p_size")).cast("double").alias("y1"))


BOXES = "boxes AS (SELECT p_partkey // 50 AS page, p_partkey AS id, CAST((p_partkey * 37) % 500 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 700 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 500 + 40 + p_size AS DOUBLE) AS x1, CAST((p_partkey * 53) % 700 + 30 + 2 * p_size AS DOUBLE) AS y1 FROM part)"


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions built of parts and orders: id, title, text."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    parts = part.agg(F.count(F.lit(1)).alias("parts"))  # one row
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(parts)).join(part, F.col("o_orderkey") % F.col("parts") + 1 == F.col("p_partkey"))
    kinds = F.array(*[F.lit(t) for t in TITLES])
    title = F.concat(F.lit("Figure "), (F.col("o_orderkey") % 30).cast("string"), F.lit(". "), F.element_at(kinds, (F.col("o_orderkey") % len(TITLES) + 1).cast("int")), F.lit(" "), "p_name")
    text = F.concat(F.lit("VDS = "), F.col("p_size").cast("string"), F.lit(" V, typ "), F.col("p_retailprice").cast("int").cast("string"), F.lit(" pF at 25 °C and 125 °C, "), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), title.alias("title"), text.alias("text"))


TITLES = ["Typical Transfer Characteristics", "Drain-Source On-State Resistance", "Body Diode Forward Voltage", "Capacitances Ciss/Coss", "Gate Charge Waveform", "Safe Operating Area", "Output Characteristics", "Max. Transient Thermal Impedance", "Coss stored energy", "Drain-source breakdown voltage vs temperature", "Switching test circuit", "ID-VGS", "Symbol Test Conditions Min Typ Max Unit", "RDS(on) - Tj", "Lower losses for faster and more efficient switching"]
_LIST = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TITLES) + "]"
CAPTIONS = f"caps AS (SELECT o_orderkey AS id, concat('Figure ', o_orderkey % 30, '. ', {_LIST}[CAST(o_orderkey % {len(TITLES)} + 1 AS INT)], ' ', p_name) AS title, concat('VDS = ', p_size, ' V, typ ', CAST(trunc(p_retailprice) AS BIGINT), ' pF at 25 °C and 125 °C, ', o_orderpriority) AS text FROM orders JOIN part ON o_orderkey % (SELECT count(*) FROM part) + 1 = p_partkey)"
