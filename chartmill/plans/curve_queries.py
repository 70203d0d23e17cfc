"""Queries of the curve algebra over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curves as C
from .adapters import CLEAN, POINTS, STEPS, event_points

R = 4


def _round(df, **digits):
    return df.select(*[F.round(c, digits.get(c, R)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _clean(spark, d):
    return C.clean_points(event_points(spark, d)).select("curve", "x", "y")


def _q(f):
    return lambda spark, d: _round(f(_clean(spark, d)))


def curve_charge(spark, d):
    """The minimum slice: clean, integrate, fit, and say whether the curve can be used."""
    pts = event_points(spark, d)
    got = C.charge(C.clean_points(pts).select("curve", "x", "y"))
    why = C.refused_curves(pts).select("curve", "status")
    return _round(why.join(got, "curve", "left").select("curve", "n_points", "charge", "energy", "slope", "intercept", "status"), slope=6)


QUERIES = {
    "curve_clean": (lambda s, d: _round(C.clean_points(event_points(s, d)), x=8), f"WITH {CLEAN}, n AS (SELECT curve, round(greatest(x, 0), 10) AS x, count(*) AS n_merged FROM pts WHERE y > 0 GROUP BY 1, 2) SELECT cl.curve, round(cl.x, 8) AS x, round(cl.y, 4) AS y, n_merged FROM cl JOIN n USING (curve, x)"),
    "curve_refusals": (lambda s, d: C.refused_curves(event_points(s, d).withColumn("y", F.when(F.col("curve") % 7 != 0, F.col("y"))).withColumn("curve", F.when(F.col("curve") % 5 == 0, -F.col("seq")).otherwise(F.col("curve")))), f"WITH {POINTS}, p AS (SELECT CASE WHEN curve % 5 = 0 THEN -seq ELSE curve END AS curve, x, CASE WHEN curve % 7 <> 0 THEN y END AS y, seq FROM pts), s AS (SELECT curve, count(*) AS n_rows, count(*) FILTER (y > 0) AS n_usable, count(DISTINCT CASE WHEN y > 0 THEN round(greatest(x, 0), 10) END) AS n_distinct_x, count(*) FILTER (y IS NULL OR x IS NULL) AS blank FROM p GROUP BY 1) SELECT curve, n_rows, n_usable, n_distinct_x, CASE WHEN blank = n_rows THEN 'withheld' WHEN n_usable < 2 THEN 'too_few_samples' WHEN n_distinct_x < 2 THEN 'too_few_distinct_x' ELSE 'ok' END AS status FROM s"),
    "curve_charge": (curve_charge, f"WITH {STEPS}, g AS (SELECT curve, count(*) AS n_points, round(coalesce(sum(0.5 * (y + py) * dx), 0), 4) AS charge, round(coalesce(sum(0.5 * (x * y + px * py) * dx), 0), 4) AS energy, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM st GROUP BY 1) SELECT u.curve, n_points, charge, energy, slope, intercept, CASE WHEN n_points IS NULL THEN 'too_few_samples' ELSE 'ok' END AS status FROM (SELECT DISTINCT curve FROM pts) u LEFT JOIN g USING (curve)"),
    "curve_cumulative": (_q(C.cumulative), f"WITH {STEPS} SELECT curve, round(x, 4) AS x, round(y, 4) AS y, round(sum(coalesce(0.5 * (y + py) * dx, 0)) OVER w, 4) AS charge, round(sum(coalesce(0.5 * (x * y + px * py) * dx, 0)) OVER w, 4) AS energy FROM st WINDOW w AS (PARTITION BY curve ORDER BY x ROWS UNBOUNDED PRECEDING)"),
    "curve_partitioned_integral": (_q(lambda p: C.partitioned_integral(p, F.lit(200.0), F.lit(500.0))), f"WITH {STEPS} SELECT curve, round(coalesce(sum(CASE WHEN 0.5 * (x + px) < 200 THEN 0.5 * (y + py) * dx END), 0), 4) AS below, round(coalesce(sum(CASE WHEN 0.5 * (x + px) BETWEEN 200 AND 500 THEN 0.5 * (y + py) * dx END), 0), 4) AS inside, round(coalesce(sum(CASE WHEN 0.5 * (x + px) > 500 THEN 0.5 * (y + py) * dx END), 0), 4) AS above FROM st GROUP BY 1"),
    "curve_masked_integral": (_q(lambda p: C.masked_integral(p, F.col("y") > 100)), f"WITH {STEPS} SELECT curve, round(coalesce(sum(CASE WHEN y > 100 OR py > 100 THEN 0.5 * (y + py) * dx END), 0), 4) AS masked, count(*) FILTER (y > 100) AS n_masked FROM st GROUP BY 1"),
    "curve_span_stats": (_q(C.span_stats), f"WITH {STEPS}, f AS (SELECT *, greatest(1, n // 5) AS fifth FROM st), g AS (SELECT curve, count(*) AS n_points, max(x) - min(x) AS x_span, max(y) - min(y) AS y_range, median(CASE WHEN i <= fifth THEN y END) AS left_median, median(CASE WHEN i > n - fifth THEN y END) AS right_median FROM f GROUP BY 1) SELECT curve, n_points, round(x_span, 4) AS x_span, round(y_range, 4) AS y_range, round(left_median, 4) AS left_median, round(right_median, 4) AS right_median, round(right_median / nullif(left_median, 0) - 1, 4) AS rise FROM g"),
    "curve_monotone": (_q(lambda p: C.monotone_violations(p, 5.0)), f"WITH {STEPS}, g AS (SELECT curve, count(py) AS n_steps, count(*) FILTER (y - py < -5) AS n_falls, greatest(max(py - y), 0) AS largest_fall, max(dx) AS largest_gap, max(x) - min(x) AS span FROM st GROUP BY 1) SELECT curve, n_steps, n_falls, round(n_falls / nullif(n_steps, 0), 4) AS fall_fraction, round(largest_fall, 4) AS largest_fall, round(largest_gap, 4) AS largest_gap, round(largest_gap / nullif(span, 0), 4) AS gap_fraction FROM g"),
    "curve_islands": (_q(lambda p: C.islands(p, 12.0)), f"WITH {STEPS}, s AS (SELECT *, sum(CASE WHEN dx > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY curve ORDER BY x ROWS UNBOUNDED PRECEDING) AS island FROM st) SELECT curve, CAST(island AS BIGINT) AS island, round(min(x), 4) AS x_from, round(max(x), 4) AS x_to, count(*) AS n_points FROM s GROUP BY 1, 2"),
    "curve_sign_runs": (_q(lambda p: C.sign_runs(p.withColumn("y", F.col("y") - 50), 5.0, 2)), f"WITH {CLEAN}, s AS (SELECT curve, x, CASE WHEN y - 50 > 5 THEN 1 WHEN y - 50 < -5 THEN -1 ELSE 0 END AS sign FROM cl), c AS (SELECT *, CASE WHEN sign <> coalesce(lag(sign) OVER (PARTITION BY curve ORDER BY x), 99) THEN 1 ELSE 0 END AS new FROM s), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY curve ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c) SELECT curve, run, sign, round(min(x), 4) AS x_from, round(max(x), 4) AS x_to, count(*) AS n_points FROM r GROUP BY 1, 2, 3 HAVING sign <> 0 AND count(*) >= 2"),
    "curve_nearest_known": (lambda s, d: _round(C.nearest_known(_clean(s, d), F.when(F.col("y") > 100, F.col("y")))), f"WITH {CLEAN} SELECT curve, round(x, 4) AS x, round(y, 4) AS y, round(last_value(CASE WHEN y > 100 THEN y END IGNORE NULLS) OVER (PARTITION BY curve ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS before, round(first_value(CASE WHEN y > 100 THEN y END IGNORE NULLS) OVER (PARTITION BY curve ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS after FROM cl"),
    "curve_moving_average": (_q(C.moving_average), f"WITH {STEPS} SELECT curve, round(x, 4) AS x, round(y, 4) AS y, round((sum(y) OVER w + greatest(4 - (i - 1), 0) * first_value(y) OVER f + greatest(4 - (n - i), 0) * last_value(y) OVER f) / 9, 4) AS smooth FROM st WINDOW w AS (PARTITION BY curve ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), f AS (PARTITION BY curve ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "curve_sliding_median": (_q(C.sliding_median), f"WITH {CLEAN} SELECT curve, round(x, 4) AS x, round(y, 4) AS y, round(median(y) OVER (PARTITION BY curve ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS mid FROM cl"),
    "curve_leading_clip": (_q(lambda p: C.leading_clip(p, F.lit(20.0))), f"WITH {STEPS}, g AS (SELECT curve, max(n) AS n, min(CASE WHEN NOT y >= 20 * 0.98 THEN i - 1 END) AS k, arg_min(x, CASE WHEN NOT y >= 20 * 0.98 THEN i - 1 END) AS ax FROM st GROUP BY 1) SELECT curve, coalesce(k, n) AS n_clipped, CASE WHEN k > 0 AND k < n - 2 THEN round(ax, 4) END AS boundary_x FROM g"),
    "curve_first_crossing": (_q(lambda p: C.first_crossing(p.withColumn("y", F.col("y") - 60))), f"WITH {CLEAN}, z AS (SELECT curve, x, y - 60 AS y FROM cl), s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM z WINDOW w AS (PARTITION BY curve ORDER BY x)), h AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY x) AS r, count(*) OVER (PARTITION BY curve) AS n_crossings FROM s WHERE py IS NOT NULL AND sign(y) * sign(py) <= 0) SELECT curve, round(CASE WHEN y = py THEN px ELSE px - py * (x - px) / (y - py) END, 4) AS x_cross, n_crossings FROM h WHERE r = 1"),
    "curve_resample_gaps": (lambda s, d: _round(C.resample_gaps(_clean(s, d), 25.0), x=7, y=7), f"WITH {CLEAN}, s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM cl WINDOW w AS (PARTITION BY curve ORDER BY x)), c AS (SELECT curve, median(nx - x) AS cadence FROM s GROUP BY 1), k AS (SELECT s.*, CASE WHEN cadence > 0 AND nx - x > 1.5 * cadence AND abs(ny - y) <= 25 THEN floor((nx - x) / cadence) ELSE 1 END AS n FROM s JOIN c USING (curve)), e AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS j FROM k) SELECT curve, round(x + CASE WHEN j > 0 THEN (nx - x) * j / n ELSE 0 END, 7) AS x, round(y + CASE WHEN j > 0 THEN (ny - y) * j / n ELSE 0 END, 7) AS y, j > 0 AS filled FROM e"),
    "curve_percentiles": (_q(C.percentiles), f"WITH {CLEAN}, s AS (SELECT *, lead(y) OVER w - 2 * y + lag(y) OVER w AS d2 FROM cl WINDOW w AS (PARTITION BY curve ORDER BY x)) SELECT curve, round(quantile_cont(y, 0.1), 4) AS p10, round(quantile_cont(y, 0.5), 4) AS p50, round(quantile_cont(y, 0.9), 4) AS p90, round(avg(abs(d2)), 4) AS roughness FROM s GROUP BY 1"),
    "curve_coarse_monotone": (_q(C.coarse_monotone), f"WITH {CLEAN}, s AS (SELECT *, min(x) OVER (PARTITION BY curve) AS lo, max(x) OVER (PARTITION BY curve) AS hi FROM cl), m AS (SELECT curve, CAST(CASE WHEN hi > lo THEN least(23, floor((x - lo) / (hi - lo) * 24)) ELSE 0 END AS BIGINT) AS bin, median(y) AS mid FROM s GROUP BY 1, 2), t AS (SELECT *, max(mid) OVER (PARTITION BY curve ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m) SELECT curve, count(*) AS n_bins, round(greatest(coalesce(max(top - mid), 0), 0), 4) AS largest_fall FROM t GROUP BY 1"),
    "curve_three_segments": (lambda s, d: _round(C.three_segments(_clean(s, d)), sse=1), f"""WITH {CLEAN}, u AS (SELECT * FROM cl), p AS (SELECT curve, row_number() OVER w AS i, count(*) OVER (PARTITION BY curve) AS n, sum(x) OVER w AS sx, sum(y) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(x * y) OVER w AS sxy, sum(y * y) OVER w AS syy FROM u WINDOW w AS (PARTITION BY curve ORDER BY x ROWS UNBOUNDED PRECEDING)),
 o AS (SELECT * FROM p WHERE n >= 6), seg AS (SELECT h.curve, h.i AS hi, coalesce(l.i, 0) AS lo, h.n, h.i - coalesce(l.i, 0) AS k, h.sx - coalesce(l.sx, 0) AS sx, h.sy - coalesce(l.sy, 0) AS sy, h.sxx - coalesce(l.sxx, 0) AS sxx, h.sxy - coalesce(l.sxy, 0) AS sxy, h.syy - coalesce(l.syy, 0) AS syy FROM o h JOIN (SELECT curve, i, sx, sy, sxx, sxy, syy FROM o UNION ALL SELECT DISTINCT curve, 0, 0, 0, 0, 0, 0 FROM o) l ON l.curve = h.curve AND l.i + 2 <= h.i),
 e AS (SELECT curve, hi, lo, n, greatest(syy - sy * sy / k - CASE WHEN sxx - sx * sx / k > 1e-12 THEN (sxy - sx * sy / k) * (sxy - sx * sy / k) / (sxx - sx * sx / k) ELSE 0 END, 0) AS sse FROM seg),
 t AS (SELECT a.curve, a.n, a.hi AS x1, b.hi AS x2, a.sse + b.sse + c.sse AS sse FROM e a JOIN e b ON a.curve = b.curve AND a.lo = 0 AND b.lo = a.hi JOIN e c ON c.curve = b.curve AND c.lo = b.hi AND c.hi = c.n)
 SELECT curve, n AS n_points, x1 AS first_split, x2 AS second_split, round(sse, 1) AS sse FROM t QUALIFY row_number() OVER (PARTITION BY curve ORDER BY round(sse, 6), x1, x2) = 1"""),
}
