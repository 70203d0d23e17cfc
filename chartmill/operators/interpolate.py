"""Interpolation joins of probes (curve, px) against points (curve, x, y): three named operators with different edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bracketed(points: DataFrame, probes: DataFrame) -> DataFrame:
    """probes + x0, y0, x1, y1: the last point at or before and the first at or after each probe; one shuffle on curve.

    Points and probes are unioned and the neighbours read off by two ordered windows: no theta join."""
    cols = [c for c in probes.columns if c not in ("curve", "px")]
    u = points.select("curve", "x", "y", F.lit(0).alias("_probe"), *[F.lit(None).cast(dict(probes.dtypes)[c]).alias(c) for c in cols]).unionByName(probes.select("curve", F.col("px").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("_probe"), *cols))
    p = F.when(F.col("_probe") == 0, F.struct("x", "y"))
    back = Window.partitionBy("curve").orderBy("x", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("curve").orderBy(F.desc("x"), "_probe").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_a", F.last(p, ignorenulls=True).over(back)).withColumn("_b", F.last(p, ignorenulls=True).over(ahead)).where("_probe = 1")
    return u.select("curve", F.col("x").alias("px"), *cols, F.col("_a.x").alias("x0"), F.col("_a.y").alias("y0"), F.col("_b.x").alias("x1"), F.col("_b.y").alias("y1"))


def _lerp():
    return F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("px") - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("y0"))


def interp_inside(points: DataFrame, probes: DataFrame) -> DataFrame:
    """value is null outside the curve's span."""
    b = bracketed(points, probes)
    return b.withColumn("value", F.when(F.col("x0").isNotNull() & F.col("x1").isNotNull(), _lerp())).drop("x0", "y0", "x1", "y1")


def interp_near(points: DataFrame, probes: DataFrame, most_gap: float) -> DataFrame:
    """As interp_inside, and null where the points around the probe are more than most_gap apart; reason says which."""
    b = bracketed(points, probes)
    inside = F.col("x0").isNotNull() & F.col("x1").isNotNull()
    near = inside & (F.col("x1") - F.col("x0") <= most_gap)
    return b.withColumn("value", F.when(near, _lerp())).withColumn("reason", F.when(~inside, "outside_span").when(~near, "inside_gap")).drop("x0", "y0", "x1", "y1")


def interp_clamped(points: DataFrame, probes: DataFrame) -> DataFrame:
    """Beyond the ends the end values hold."""
    b = bracketed(points, probes)
    return b.withColumn("value", F.when(F.col("x0").isNull(), F.col("y1")).when(F.col("x1").isNull(), F.col("y0")).otherwise(_lerp())).drop("x0", "y0", "x1", "y1")


def shared_grid(points: DataFrame, pair: DataFrame, samples: int) -> DataFrame:
    """pair (pair, left, right) of curves -> pair, i, gx, left_value, right_value on `samples` even steps over their common span."""
    span = points.groupBy("curve").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    l, r = span.toDF("left", "llo", "lhi"), span.toDF("right", "rlo", "rhi")
    g = pair.join(l, "left").join(r, "right").withColumn("lo", F.greatest("llo", "rlo")).withColumn("hi", F.least("lhi", "rhi")).where("hi > lo")
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("gx", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (samples - 1))
    one = interp_clamped(points, g.select(F.col("left").alias("curve"), F.col("gx").alias("px"), "pair", "i")).select("pair", "i", F.col("px").alias("gx"), F.col("value").alias("left_value"))
    two = interp_clamped(points, g.select(F.col("right").alias("curve"), F.col("gx").alias("px"), "pair", "i")).select("pair", "i", F.col("value").alias("right_value"))
    return one.join(two, ["pair", "i"])


def collapse(grid: DataFrame, within: float) -> DataFrame:
    """pair -> share of grid samples where both curves agree within `within`, and the longest run of such samples."""
    w = Window.partitionBy("pair").orderBy("i")
    g = grid.withColumn("_same", F.abs(F.col("left_value") - F.col("right_value")) <= within)
    g = g.withColumn("_run", F.col("i") - F.sum(F.when(F.col("_same"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = g.groupBy("pair", "_run").agg(F.count_if("_same").alias("_n"), F.count(F.lit(1)).alias("_all"))
    return runs.groupBy("pair").agg((F.sum("_n") / F.sum("_all")).alias("collapse_fraction"), F.max("_n").alias("longest_run"))
