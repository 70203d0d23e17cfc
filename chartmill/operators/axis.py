"""Axis calibration from tick tables: (axis, pixel, value). Refusals are statuses with a reason, never errors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import per_key


def by_axis() -> Window:
    return Window.partitionBy("axis")


def fit_axes(ticks: DataFrame, model: str = "auto", least_ticks: int = 2, floor_px: float = 1.5, span_share: float = 0.03, ambiguity_px: float = 0.75, ambiguity_share: float = 0.005) -> DataFrame:
    """axis -> status, model, m, b, residual_px, runner_up_px, n_ticks.

    Ticks are ordered by pixel. Refused: fewer than least_ticks; pixels not strictly increasing or values not
    strictly monotone; a forced log axis with a value <= 0; no candidate with a slope; a best residual over
    max(floor_px, span_share of the span); a runner-up within max(ambiguity_px, ambiguity_share of the span).
    The residual is the RMS of the ticks' pixels against the inverted fit."""
    order = by_axis().orderBy("pixel", "value")
    t = ticks.select("axis", F.col("pixel").cast("double").alias("pixel"), F.col("value").cast("double").alias("value")).where("pixel IS NOT NULL AND value IS NOT NULL")
    t = t.withColumn("_dp", F.col("pixel") - F.lag("pixel").over(order)).withColumn("_dv", F.col("value") - F.lag("value").over(order))
    shape = t.groupBy("axis").agg(F.count(F.lit(1)).alias("n_ticks"), F.coalesce(F.min("_dp") > 0, F.lit(True)).alias("_ordered"), F.coalesce((F.min("_dv") > 0) | (F.max("_dv") < 0), F.lit(True)).alias("_monotone"), (F.min("value") > 0).alias("_positive"), (F.max("pixel") - F.min("pixel")).alias("_span"))
    names = ["linear", "log10"] if model == "auto" else [model]
    positive = F.min("value").over(by_axis()) > 0
    rows = t.withColumn("_pos", positive).withColumn("model", F.explode(F.array(*[F.lit(x) for x in names]))).where((F.col("model") == "linear") | F.col("_pos"))
    rows = rows.withColumn("_c", F.when(F.col("model") == "log10", F.log10(F.when(F.col("value") > 0, F.col("value")))).otherwise(F.col("value")))
    line = rows.groupBy("axis", "model").agg(F.regr_slope("_c", "pixel").alias("m"), F.regr_intercept("_c", "pixel").alias("b"))
    far = rows.join(line, ["axis", "model"]).where(F.abs("m") >= 1e-12).groupBy("axis", "model").agg(F.sqrt(F.avg(F.pow(F.try_divide(F.col("_c") - F.col("b"), F.col("m")) - F.col("pixel"), F.lit(2.0)))).alias("residual_px"), F.first("m").alias("m"), F.first("b").alias("b"))
    rank = by_axis().orderBy("residual_px", "model")
    best = far.withColumn("_r", F.row_number().over(rank)).withColumn("runner_up_px", F.lead("residual_px").over(rank)).where("_r = 1").drop("_r")
    out = shape.join(best, "axis", "left")
    status = (
        F.when(F.col("n_ticks") < least_ticks, "too_few_ticks")
        .when(~F.col("_ordered") | ~F.col("_monotone"), "not_monotone")
        .when(F.lit(model == "log10") & ~F.col("_positive"), "log_needs_positive")
        .when(F.col("residual_px").isNull(), "no_candidate")
        .when(F.col("residual_px") > F.greatest(F.lit(floor_px), span_share * F.col("_span")), "residual_untrusted")
        .when(F.coalesce(F.col("runner_up_px") - F.col("residual_px") <= F.greatest(F.lit(ambiguity_px), ambiguity_share * F.col("_span")), F.lit(False)), "ambiguous")
        .otherwise("ok")
    )
    out = out.withColumn("status", status)
    served = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    return out.select("axis", "status", "n_ticks", served("model"), served("m"), served("b"), "residual_px", "runner_up_px")


def fit_policy(ticks: DataFrame, least_ticks: int, span_share: float) -> DataFrame:
    """A forced linear fit after exact duplicates are removed, judged by its largest value error as a share of the value span."""
    t = ticks.select("axis", "pixel", "value").distinct()
    line = t.groupBy("axis").agg(F.count(F.lit(1)).alias("n_ticks"), F.regr_slope("value", "pixel").alias("m"), F.regr_intercept("value", "pixel").alias("b"), (F.max("value") - F.min("value")).alias("_span"))
    err = t.join(line, "axis").groupBy("axis").agg(F.max(F.abs(F.col("m") * F.col("pixel") + F.col("b") - F.col("value"))).alias("max_error"))
    out = line.join(err, "axis")
    status = F.when(F.col("n_ticks") < least_ticks, "too_few_ticks").when(F.abs(F.coalesce(F.col("m"), F.lit(0.0))) < 1e-9, "no_candidate").when(F.col("max_error") > span_share * F.col("_span"), "residual_untrusted").otherwise("ok")
    return out.withColumn("status", status).select("axis", "n_ticks", "m", "b", "max_error", "status")


def value_at(pixel: Column, model: Column, m: Column, b: Column) -> Column:
    c = m * pixel + b
    return F.when(model == "log10", F.pow(F.lit(10.0), c)).otherwise(c)


def pixel_at(value: Column, model: Column, m: Column, b: Column) -> Column:
    return (F.when(model == "log10", F.log10(F.when(value > 0, value))).otherwise(value) - b) / F.nullif(m, F.lit(0.0))


def clipped_value(pixel: Column, px0: Column, px1: Column, v0: Column, v1: Column, log: Column) -> Column:
    """Calibration between frame edges, the pixel clipped to the frame; log interpolates decades."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(pixel - px0, px1 - px0)))
    return F.when(log, F.pow(F.lit(10.0), F.log10(v0) + share * (F.log10(v1) - F.log10(v0)))).otherwise(v0 + share * (v1 - v0))


def to_crop(x_pt: Column, y_pt: Column, box: dict[str, Column], width: Column, height: Column) -> tuple[Column, Column]:
    """PDF points to crop pixels."""
    return (x_pt - box["x0"]) * width / (box["x1"] - box["x0"]), (y_pt - box["y0"]) * height / (box["y1"] - box["y0"])


def tick_columns(labels: DataFrame, gap: float) -> DataFrame:
    """1-D gap clustering: labels (page, x, ...) + column number; a step over `gap` starts a new column."""
    w = Window.partitionBy("page").orderBy("x", "id")
    return labels.withColumn("column", F.sum(F.when(F.col("x") - F.lag("x").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def maximal_linear_runs(ticks: DataFrame, least: int = 3, floor: float = 0.35, share: float = 0.08) -> DataFrame:
    """Maximal runs of consecutive ticks that are strictly monotone and linear within max(floor, share of the mean step).

    An axis is read once, in order: from each tick a run grows while it is monotone, with running moments about its own mean, so
    that ticks far from pixel 0 lose no digits. Runs inside another accepted run are dropped."""
    kind = ticks.schema["axis"].dataType.simpleString()

    def run(axis, c: dict[str, np.ndarray]) -> list[tuple]:
        x, y = c["pixel"].tolist(), c["value"].tolist()
        n, reach, out = len(y), -1, []
        sign = [0, *[(v > u) - (v < u) for u, v in zip(y, y[1:], strict=False)]]
        end = list(range(n))
        for i in range(n - 2, -1, -1):
            if sign[i + 1]:
                end[i] = end[i + 1] if i + 2 < n and sign[i + 2] == sign[i + 1] else i + 1
        for i in range(n):
            if end[i] <= reach:
                continue
            mx, my, xx, xy, yy = x[i], y[i], 0.0, 0.0, 0.0
            best = (i, 0.0) if least <= 1 and mx == mx and my == my else None
            for j in range(i + 1, end[i] + 1):
                k, dx, dy = j - i + 1, x[j] - mx, y[j] - my
                mx, my = mx + dx / k, my + dy / k
                xx, xy, yy = xx + dx * (x[j] - mx), xy + dx * (y[j] - my), yy + dy * (y[j] - my)
                rms = math.sqrt(max(yy - (xy * xy / xx if xx > 1e-12 else 0.0), 0.0) / k)
                if k >= least and rms <= max(floor, share * abs(y[j] - y[i]) / (j - i)):
                    best = (j, rms)
            if best and best[0] > reach:
                out.append((axis, i + 1, best[0] + 1, best[1]))
                reach = best[0]
        return out

    used = ticks.select("axis", F.col("pixel").cast("double").alias("pixel"), F.col("value").cast("double").alias("value"))
    return per_key(used, "axis", ["pixel", "value"], run, f"axis {kind}, start bigint, stop bigint, rms double", ("pixel", "value"))


def consensus_fit(ticks: DataFrame, inlier: float = 0.35) -> DataFrame:
    """Each pair of ticks proposes a line; its inliers are refitted; the line with most inliers, then widest span, then least residual wins."""
    t = ticks.select("axis", "pixel", "value").distinct()
    a, b = t.toDF("axis", "pa", "va"), t.toDF("axis", "pb", "vb")
    pair = a.join(b, "axis").where("pa < pb AND va <> vb").withColumn("_m", F.try_divide(F.col("vb") - F.col("va"), F.col("pb") - F.col("pa"))).withColumn("_b", F.col("va") - F.col("_m") * F.col("pa"))
    near = pair.join(t, "axis").where(F.abs(F.col("_m") * F.col("pixel") + F.col("_b") - F.col("value")) <= inlier)
    fit = near.groupBy("axis", "pa", "va", "pb", "vb").agg(F.count(F.lit(1)).alias("n_inliers"), (F.max("pixel") - F.min("pixel")).alias("span_px"), F.regr_slope("value", "pixel").alias("m"), F.regr_intercept("value", "pixel").alias("b"), F.regr_syy("value", "pixel").alias("_yy"), F.regr_sxy("value", "pixel").alias("_xy"), F.regr_sxx("value", "pixel").alias("_xx"))
    fit = fit.withColumn("_sse", F.round(F.greatest(F.col("_yy") - F.col("_xy") * F.col("_xy") / F.nullif("_xx", F.lit(0.0)), F.lit(0.0)), 6))
    order = by_axis().orderBy(F.desc("n_inliers"), F.desc("span_px"), "_sse", "pa", "va", "pb", "vb")
    return fit.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("axis", "n_inliers", "span_px", "m", "b")


def drop_offset_tick(ticks: DataFrame, least: int = 5, shrink: float = 3.0) -> DataFrame:
    """Leave-one-out: the tick whose removal shrinks the fit's residual at least `shrink` times, in axes of `least` ticks or more."""
    t = ticks.select("axis", "pixel", "value").withColumn("i", F.row_number().over(by_axis().orderBy("pixel", "value"))).withColumn("n", F.count(F.lit(1)).over(by_axis())).where(F.col("n") >= least)
    rms = lambda: F.sqrt(F.greatest(F.regr_syy("value", "pixel") - F.regr_sxy("value", "pixel") * F.regr_sxy("value", "pixel") / F.nullif(F.regr_sxx("value", "pixel"), F.lit(0.0)), F.lit(0.0)) / F.count(F.lit(1)))
    whole = t.groupBy("axis").agg(rms().alias("rms_all"))
    out = t.select("axis", F.col("i").alias("drop")).join(t, "axis").where("i <> drop").groupBy("axis", "drop").agg(rms().alias("rms_left"))
    best = out.withColumn("_r", F.row_number().over(by_axis().orderBy(F.round("rms_left", 6), "drop"))).where("_r = 1")
    return best.join(whole, "axis").select("axis", F.when(F.round("rms_all", 6) >= shrink * F.round("rms_left", 6) + 1e-6, F.col("drop")).cast("bigint").alias("dropped"), "rms_all", "rms_left")


def one_tick_a_value(ticks: DataFrame) -> DataFrame:
    """Of ticks with the same value, the one closest to the axis's common line stays (ties: the smaller pixel)."""
    line = ticks.groupBy("axis").agg(F.regr_slope("value", "pixel").alias("m"), F.regr_intercept("value", "pixel").alias("b"))
    far = ticks.join(line, "axis").withColumn("_d", F.round(F.abs(F.col("m") * F.col("pixel") + F.col("b") - F.col("value")), 9))
    return far.withColumn("_r", F.row_number().over(Window.partitionBy("axis", "value").orderBy("_d", "pixel"))).where("_r = 1").select("axis", "pixel", "value")


def uniform_run(tokens: DataFrame) -> DataFrame:
    """tokens (axis, i, value) -> the longest strictly increasing run of consecutive tokens from a zero, and whether its steps are uniform."""
    w = by_axis().orderBy("i")
    t = tokens.withColumn("_dv", F.col("value") - F.lag("value").over(w)).withColumn("_new", F.when((F.col("value") == 0) | ~F.coalesce(F.col("_dv") > 0, F.lit(False)), 1).otherwise(0))
    t = t.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_in", F.when(F.col("_new") == 0, F.col("_dv")))
    g = t.groupBy("axis", "_run").agg(F.min("value").alias("first"), F.max("value").alias("last"), F.count(F.lit(1)).alias("n"), F.stddev_pop("_in").alias("_sd"), F.median("_in").alias("_md"), F.min("i").alias("start")).where("first = 0")
    best = g.withColumn("_r", F.row_number().over(by_axis().orderBy(F.desc("n"), "start"))).where("_r = 1")
    return best.select("axis", F.col("start").cast("bigint").alias("start"), "n", "last", F.coalesce(F.col("_sd") <= F.greatest(F.lit(0.05), 0.15 * F.col("_md")), F.lit(False)).alias("uniform"))


def snap_to_grid(ticks: DataFrame, rails: DataFrame, most: float) -> DataFrame:
    """ticks (axis, pixel, value) moved to the nearest rail (axis, rail) within `most`; a rail takes its nearest tick only."""
    d = ticks.join(rails, "axis").withColumn("_d", F.abs(F.col("pixel") - F.col("rail"))).where(F.col("_d") <= most)
    mine = d.withColumn("_r", F.row_number().over(Window.partitionBy("axis", "pixel", "value").orderBy("_d", "rail"))).where("_r = 1")
    own = mine.withColumn("_r", F.row_number().over(Window.partitionBy("axis", "rail").orderBy("_d", "pixel", "value"))).where("_r = 1")
    return own.select("axis", "pixel", "value", F.col("rail").alias("snapped"))
