"""Curve algebra on long point tables: (curve, x, y, seq).

A curve is a key, its points rows. Every operator is windows and aggregates over the key, so curves are
processed apart and no task needs more than one curve's sorted rows. Nulls, NaN and infinities never
count as evidence: points that aren't finite are left out, and what can't be evaluated is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_curve() -> Window:
    return Window.partitionBy("curve")


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def by_x() -> Window:
    return by_curve().orderBy("x")


def clean_points(points: DataFrame, decimals: int = 10) -> DataFrame:
    """Finite points of positive y, x clamped to 0 from below; equal abscissae (rounded) merge to their median.

    Curves with fewer than two distinct abscissae are left out (see refused_curves)."""
    good = points.where(finite(F.col("x")) & finite(F.col("y")) & (F.col("y") > 0))
    merged = good.groupBy("curve", F.round(F.greatest("x", F.lit(0.0)), decimals).alias("x")).agg(F.median("y").alias("y"), F.count(F.lit(1)).alias("n_merged"))
    return merged.withColumn("_n", F.count(F.lit(1)).over(by_curve())).where("_n >= 2").drop("_n")


def refused_curves(points: DataFrame) -> DataFrame:
    """curve, n_rows, n_usable, n_distinct_x, status: why a curve can't be used, 'ok' otherwise. All-withheld curves are told from empty ones."""
    usable = finite(F.col("x")) & finite(F.col("y")) & (F.col("y") > 0)
    s = points.groupBy("curve").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(usable).alias("n_usable"), F.count_distinct(F.when(usable, F.round(F.greatest("x", F.lit(0.0)), 10))).alias("n_distinct_x"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("_blank"))
    status = F.when(F.col("_blank") == F.col("n_rows"), "withheld").when(F.col("n_usable") < 2, "too_few_samples").when(F.col("n_distinct_x") < 2, "too_few_distinct_x").otherwise("ok")
    return s.withColumn("status", status).drop("_blank")


def _steps(points: DataFrame) -> DataFrame:
    w = by_x()
    return points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).withColumn("dx", F.col("x") - F.col("px"))


def charge(points: DataFrame) -> DataFrame:
    """Trapezoid integral of y and of x*y, and the least-squares line, by curve."""
    s = _steps(points)
    return s.groupBy("curve").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.sum(0.5 * (F.col("y") + F.col("py")) * F.col("dx")), F.lit(0.0)).alias("charge"),
        F.coalesce(F.sum(0.5 * (F.col("x") * F.col("y") + F.col("px") * F.col("py")) * F.col("dx")), F.lit(0.0)).alias("energy"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.min("x").alias("x_first"),
        F.max("x").alias("x_last"),
    )


def cumulative(points: DataFrame) -> DataFrame:
    """points + running charge and energy up to each point."""
    up = by_x().rowsBetween(Window.unboundedPreceding, 0)
    s = _steps(points)
    q = F.coalesce(0.5 * (F.col("y") + F.col("py")) * F.col("dx"), F.lit(0.0))
    e = F.coalesce(0.5 * (F.col("x") * F.col("y") + F.col("px") * F.col("py")) * F.col("dx"), F.lit(0.0))
    return s.withColumn("charge", F.sum(q).over(up)).withColumn("energy", F.sum(e).over(up)).drop("px", "py", "dx")


def partitioned_integral(points: DataFrame, low: Column, high: Column) -> DataFrame:
    """The integral split by where each interval's midpoint lies: below low, inside, above high."""
    s = _steps(points).withColumn("area", 0.5 * (F.col("y") + F.col("py")) * F.col("dx")).withColumn("mid", 0.5 * (F.col("x") + F.col("px"))).withColumn("_lo", low).withColumn("_hi", high)
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("area"))), F.lit(0.0))
    return s.groupBy("curve").agg(part(F.col("mid") < F.col("_lo")).alias("below"), part((F.col("mid") >= F.col("_lo")) & (F.col("mid") <= F.col("_hi"))).alias("inside"), part(F.col("mid") > F.col("_hi")).alias("above"))


def masked_integral(points: DataFrame, mask: Column) -> DataFrame:
    """The integral over intervals of which either end is masked."""
    s = points.withColumn("_m", F.coalesce(mask, F.lit(False)))
    s = _steps(s).withColumn("_pm", F.lag("_m").over(by_x()))
    return s.groupBy("curve").agg(F.coalesce(F.sum(F.when(F.col("_m") | F.col("_pm"), 0.5 * (F.col("y") + F.col("py")) * F.col("dx"))), F.lit(0.0)).alias("masked"), F.count_if("_m").alias("n_masked"))


def span_stats(points: DataFrame) -> DataFrame:
    """Counts, spans, and the rise: median of the right fifth over median of the left fifth of a curve's points, less 1."""
    n = F.count(F.lit(1)).over(by_curve())
    ranked = points.withColumn("_i", F.row_number().over(by_x())).withColumn("_n", n).withColumn("_fifth", F.greatest(F.lit(1), F.floor(F.col("_n") / 5)))
    return ranked.groupBy("curve").agg(
        F.count(F.lit(1)).alias("n_points"),
        (F.max("x") - F.min("x")).alias("x_span"),
        (F.max("y") - F.min("y")).alias("y_range"),
        F.median(F.when(F.col("_i") <= F.col("_fifth"), F.col("y"))).alias("left_median"),
        F.median(F.when(F.col("_i") > F.col("_n") - F.col("_fifth"), F.col("y"))).alias("right_median"),
    ).withColumn("rise", F.col("right_median") / F.nullif("left_median", F.lit(0.0)) - 1)


def monotone_violations(points: DataFrame, back_step: float = 0.0) -> DataFrame:
    """Share of steps that fall by more than back_step, the largest fall, the largest gap in x and its share of the span."""
    s = _steps(points).withColumn("dy", F.col("y") - F.col("py"))
    g = s.groupBy("curve").agg(F.count("dy").alias("n_steps"), F.count_if(F.col("dy") < -back_step).alias("n_falls"), F.coalesce(F.max(-F.col("dy")), F.lit(0.0)).alias("largest_fall"), F.max("dx").alias("largest_gap"), (F.max("x") - F.min("x")).alias("_span"))
    return g.select("curve", "n_steps", "n_falls", (F.col("n_falls") / F.nullif("n_steps", F.lit(0))).alias("fall_fraction"), F.greatest("largest_fall", F.lit(0.0)).alias("largest_fall"), "largest_gap", (F.col("largest_gap") / F.nullif("_span", F.lit(0.0))).alias("gap_fraction"))


def islands(points: DataFrame, gap: float) -> DataFrame:
    """Maximal runs of points no further apart than gap: curve, island, x_from, x_to, n_points."""
    s = _steps(points).withColumn("island", F.sum(F.when(F.col("dx") > gap, 1).otherwise(0)).over(by_x().rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("curve", F.col("island").cast("bigint").alias("island")).agg(F.min("x").alias("x_from"), F.max("x").alias("x_to"), F.count(F.lit(1)).alias("n_points"))


def sign_runs(points: DataFrame, margin: float, least: int) -> DataFrame:
    """Runs of one sign of y beyond +-margin, `least` points long at least: curve, run, sign, x_from, x_to, n_points."""
    sign = F.when(F.col("y") > margin, 1).when(F.col("y") < -margin, -1).otherwise(0)
    s = points.withColumn("sign", sign)
    s = s.withColumn("run", F.sum(F.when(F.col("sign") != F.coalesce(F.lag("sign").over(by_x()), F.lit(99)), 1).otherwise(0)).over(by_x().rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("curve", F.col("run").cast("bigint").alias("run"), "sign").agg(F.min("x").alias("x_from"), F.max("x").alias("x_to"), F.count(F.lit(1)).alias("n_points"))
    return g.where((F.col("sign") != 0) & (F.col("n_points") >= least))


def robust_sequence(points: DataFrame, margin: float, least: int) -> DataFrame:
    """curve, signs: the robust runs' signs in order, repeats merged; an empty array where there are none."""
    runs = sign_runs(points, margin, least)
    order = by_curve().orderBy("run")
    kept = runs.withColumn("_new", F.col("sign") != F.coalesce(F.lag("sign").over(order), F.lit(0))).where("_new")
    signs = kept.groupBy("curve").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "sign"))), lambda r: r["sign"].cast("string")), ",").alias("signs"))
    return points.select("curve").distinct().join(signs, "curve", "left").select("curve", F.coalesce("signs", F.lit("")).alias("signs"))


def nearest_known(points: DataFrame, value: Column) -> DataFrame:
    """points + before, after: the nearest non-null value at or before and at or after each point."""
    w = by_x()
    v = points.withColumn("_v", value)
    return v.withColumn("before", F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).drop("_v")


def moving_average(points: DataFrame, taps: int = 9) -> DataFrame:
    """points + smooth: a centred average whose edges repeat the end values instead of shrinking the window."""
    half = taps // 2
    w = by_x()
    full = by_curve().orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = points.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(by_curve())).withColumn("_a", F.first("y").over(full)).withColumn("_z", F.last("y").over(full)).withColumn("_s", F.sum("y").over(w.rowsBetween(-half, half)))
    left, right = F.greatest(half - (F.col("_i") - 1), F.lit(0)), F.greatest(half - (F.col("_n") - F.col("_i")), F.lit(0))
    return s.withColumn("smooth", (F.col("_s") + left * F.col("_a") + right * F.col("_z")) / taps).drop("_i", "_n", "_a", "_z", "_s")


def sliding_median(points: DataFrame, half: int = 3) -> DataFrame:
    """points + mid: the median of up to half neighbours on either side; windows shrink at the edges."""
    return points.withColumn("mid", F.percentile("y", F.lit(0.5)).over(by_x().rowsBetween(-half, half)))


def leading_clip(points: DataFrame, ceiling: Column, tolerance: float = 0.02) -> DataFrame:
    """curve, n_clipped, boundary_x: the run of points at the ceiling from the first one; no boundary if it leaves fewer than 3 points."""
    s = points.withColumn("_c", F.col("y") >= ceiling * (1 - tolerance)).withColumn("_i", F.row_number().over(by_x()) - 1).withColumn("_n", F.count(F.lit(1)).over(by_curve()))
    g = s.groupBy("curve").agg(F.min(F.when(~F.col("_c"), F.col("_i"))).alias("first_clear"), F.max("_n").alias("n"), F.min_by("x", F.when(~F.col("_c"), F.col("_i"))).alias("at"))
    valid = (F.col("first_clear") > 0) & (F.col("first_clear") < F.col("n") - 2)
    return g.select("curve", F.coalesce("first_clear", "n").cast("bigint").alias("n_clipped"), F.when(valid, F.col("at")).alias("boundary_x"))


def first_crossing(points: DataFrame) -> DataFrame:
    """curve, x_cross, n_crossings: where y first changes sign (or touches zero), by linear interpolation."""
    s = _steps(points).where(F.col("py").isNotNull() & (F.signum("y") * F.signum("py") <= 0))
    at = F.when(F.col("y") == F.col("py"), F.col("px")).otherwise(F.col("px") - F.col("py") * F.col("dx") / (F.col("y") - F.col("py")))
    r = s.withColumn("x_cross", at).withColumn("_r", F.row_number().over(by_x())).withColumn("n_crossings", F.count(F.lit(1)).over(by_curve()))
    return r.where("_r = 1").select("curve", "x_cross", "n_crossings")


def resample_gaps(points: DataFrame, flat: float) -> DataFrame:
    """points + rows at the curve's median cadence inside gaps over 1.5 cadences whose ends differ by `flat` at most."""
    s = points.withColumn("nx", F.lead("x").over(by_x())).withColumn("ny", F.lead("y").over(by_x()))
    cadence = s.groupBy("curve").agg(F.median(F.col("nx") - F.col("x")).alias("cadence"))
    s = s.join(cadence, "curve")
    gap = F.col("nx") - F.col("x")
    n = F.when((F.col("cadence") > 0) & (gap > 1.5 * F.col("cadence")) & (F.abs(F.col("ny") - F.col("y")) <= flat), F.floor(gap / F.col("cadence"))).otherwise(1).cast("int")
    s = s.withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    x = F.col("x") + F.when(F.col("_k") > 0, gap * F.col("_k") / n).otherwise(0.0)
    y = F.col("y") + F.when(F.col("_k") > 0, (F.col("ny") - F.col("y")) * F.col("_k") / n).otherwise(0.0)
    return s.select("curve", x.alias("x"), y.alias("y"), (F.col("_k") > 0).alias("filled"))


def percentiles(points: DataFrame, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact percentiles of y with linear interpolation, and the roughness: mean absolute second difference."""
    w = by_x()
    s = points.withColumn("_d2", F.lead("y").over(w) - 2 * F.col("y") + F.lag("y").over(w))
    return s.groupBy("curve").agg(*[F.percentile("y", F.lit(p)).alias(f"p{round(100 * p)}") for p in at], F.avg(F.abs("_d2")).alias("roughness"))


def coarse_monotone(points: DataFrame, bins: int = 24) -> DataFrame:
    """Largest fall of the medians of `bins` bins of x under their running maximum."""
    span = points.withColumn("_lo", F.min("x").over(by_curve())).withColumn("_hi", F.max("x").over(by_curve()))
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))).otherwise(0)
    mids = span.withColumn("bin", b.cast("bigint")).groupBy("curve", "bin").agg(F.median("y").alias("mid"))
    top = F.max("mid").over(by_curve().orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    return mids.withColumn("_top", top).groupBy("curve").agg(F.count(F.lit(1)).alias("n_bins"), F.greatest(F.coalesce(F.max(F.col("_top") - F.col("mid")), F.lit(0.0)), F.lit(0.0)).alias("largest_fall"))


def three_segments(points: DataFrame, least: int = 2) -> DataFrame:
    """The split of a curve into three lines with least squared error, over all split pairs; moments that grow point by point make each pair O(1).

    The moments are about each segment's own mean, so a segment of points close together keeps its digits. Curves of any length
    are fitted: a curve's pairs are scanned by the second split, in memory linear in its points and time that grows with their square. Curves of fewer than 3 * least points give no row."""
    kind = points.schema["curve"].dataType.simpleString()

    def run(pdf):
        p = pdf.sort_values("x")
        n = len(p)
        if n < 3 * least:
            return pd.DataFrame({"curve": [], "n_points": [], "first_split": [], "second_split": [], "sse": []})
        x, y = (p[k].to_numpy(float) - p[k].mean() for k in "xy")

        def add(m, k, px, py):
            dx, dy = px - m[0], py - m[1]
            m[0] += dx / k
            m[1] += dy / k
            ex, ey = px - m[0], py - m[1]
            m[2] += dx * ex
            m[3] += dx * ey
            m[4] += dy * ey

        def sse(m):
            flat = m[2] <= 1e-12
            return np.maximum(m[4] - np.where(flat, 0.0, m[3] * m[3] / np.where(flat, 1.0, m[2])), 0.0)

        best = None
        first, last, tail, made = np.zeros(n + 1), np.zeros(n + 1), np.zeros((5, 1)), np.zeros((5, n))
        for j in range(n - 1, -1, -1):
            add(tail, n - j, x[j], y[j])
            last[j] = sse(tail)[0]
        counts = np.arange(n, 0, -1)
        for j in range(1, n - least + 1):  # made: moments of the points from each start up to j
            add(made[:, :j], counts[n - j :], x[j - 1], y[j - 1])
            first[j] = sse(made[:, :1])[0]
            if j >= 2 * least:
                i = slice(least, j - least + 1)
                total = first[i] + sse(made[:, i]) + last[j]
                near = np.round(total, 6)
                at = int(near.argmin())
                if best is None or (near[at], least + at, j) < best[:3]:
                    best = (near[at], least + at, j, float(total[at]))
        return pd.DataFrame({"curve": [p["curve"].iloc[0]], "n_points": [n], "first_split": [best[1]], "second_split": [best[2]], "sse": [best[3]]})

    used = points.where(finite(F.col("x")) & finite(F.col("y"))).select("curve", F.col("x").cast("double"), F.col("y").cast("double"))
    return used.groupBy("curve").applyInPandas(run, f"curve {kind}, n_points long, first_split int, second_split int, sse double")
