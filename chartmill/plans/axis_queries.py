"""Queries of axis calibration over lineitem ticks, and of interpolation joins over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import axis as A
from ..operators import interpolate as I
from .adapters import CLEAN, TICKS, order_ticks
from .curve_queries import _clean, _round

_FIT = """t AS (SELECT *, pixel - lag(pixel) OVER w AS dp, value - lag(value) OVER w AS dv FROM src WINDOW w AS (PARTITION BY axis ORDER BY pixel, value)),
 sh AS (SELECT axis, count(*) AS n_ticks, coalesce(min(dp) > 0, true) AS ord, coalesce(min(dv) > 0 OR max(dv) < 0, true) AS mono, min(value) > 0 AS pos, max(pixel) - min(pixel) AS span FROM t GROUP BY 1),
 rw AS (SELECT t.axis, pixel, model, CASE WHEN model = 'log10' THEN log10(CASE WHEN value > 0 THEN value END) ELSE value END AS c FROM t JOIN sh USING (axis) CROSS JOIN (SELECT unnest({models}) AS model) WHERE model = 'linear' OR pos),
 ln AS (SELECT axis, model, regr_slope(c, pixel) AS m, regr_intercept(c, pixel) AS b FROM rw GROUP BY 1, 2),
 fr AS (SELECT axis, model, m, b, sqrt(avg(((c - b) / m - pixel) * ((c - b) / m - pixel))) AS residual_px FROM rw JOIN ln USING (axis, model) WHERE abs(m) >= 1e-12 GROUP BY 1, 2, 3, 4),
 be AS (SELECT *, lead(residual_px) OVER w AS runner_up_px, row_number() OVER w AS r FROM fr WINDOW w AS (PARTITION BY axis ORDER BY residual_px, model)),
 st AS (SELECT sh.*, model, m, b, residual_px, runner_up_px, CASE WHEN n_ticks < {least} THEN 'too_few_ticks' WHEN NOT ord OR NOT mono THEN 'not_monotone' {log} WHEN residual_px IS NULL THEN 'no_candidate' WHEN residual_px > greatest({floor}, {share} * span) THEN 'residual_untrusted' WHEN coalesce(runner_up_px - residual_px <= greatest(0.75, 0.005 * span), false) THEN 'ambiguous' ELSE 'ok' END AS status FROM sh LEFT JOIN (SELECT * FROM be WHERE r = 1) q USING (axis))
 SELECT axis, status, n_ticks, CASE WHEN status = 'ok' THEN model END AS model, round(CASE WHEN status = 'ok' THEN m END, 6) AS m, round(CASE WHEN status = 'ok' THEN b END, 4) AS b, round(residual_px, 3) AS residual_px, round(runner_up_px, 3) AS runner_up_px FROM st"""


def _fit_sql(src: str, models: str, floor: float, share: float, log: str = "") -> str:
    return f"WITH {TICKS}, src AS ({src}), " + _FIT.format(models=models, least=2, floor=floor, share=share, log=log)


def _fit(df):
    return _round(df, m=6, residual_px=3, runner_up_px=3)


def _shaped(s, d):
    """Ticks that calibrate: an order's line numbers, with values linear, decades or as printed, by order."""
    t = order_ticks(s, d)
    k = F.col("pixel") / 40
    v = F.when(F.col("axis") % 3 == 0, 5.0 * k).when(F.col("axis") % 3 == 1, F.pow(F.lit(10.0), k - 1)).otherwise(F.col("value"))
    return t.groupBy("axis", "pixel").agg(F.min("value").alias("value")).withColumn("value", v)


_SHAPED = "SELECT axis, pixel, CASE WHEN axis % 3 = 0 THEN 5.0 * (pixel / 40) WHEN axis % 3 = 1 THEN pow(10.0, pixel / 40 - 1) ELSE v END AS value FROM (SELECT axis, pixel, min(value) AS v FROM ticks GROUP BY 1, 2)"
_PROBES = "pr AS (SELECT DISTINCT curve, CAST(60 * k AS DOUBLE) + 0.5 AS px FROM cl CROSS JOIN (SELECT unnest(range(0, 13)) AS k))"
_BRACKET = f"WITH {CLEAN}, {_PROBES}, br AS (SELECT pr.curve, px, max(CASE WHEN x <= px THEN x END) AS x0, arg_max(y, CASE WHEN x <= px THEN x END) AS y0, min(CASE WHEN x >= px THEN x END) AS x1, arg_min(y, CASE WHEN x >= px THEN x END) AS y1 FROM pr JOIN cl USING (curve) GROUP BY 1, 2), v AS (SELECT *, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (px - x0) / (x1 - x0) ELSE y0 END AS lerp FROM br)"


def _probes(s, d):
    return _clean(s, d).select("curve").distinct().withColumn("px", F.explode(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: k.cast("double") * 60 + 0.5)))


def _grid(s, d):
    p = _clean(s, d)
    c = p.select("curve").distinct()
    pair = c.select(F.col("curve").alias("left"), (F.col("curve") + 1).alias("right")).where("left % 2 = 0").withColumn("pair", F.col("left"))
    return I.shared_grid(p, pair, 120)


_GRID = f"""WITH {CLEAN}, sp AS (SELECT curve, min(x) AS lo, max(x) AS hi FROM cl GROUP BY 1), g AS (SELECT l.curve AS pair, l.curve AS lft, r.curve AS rgt, greatest(l.lo, r.lo) AS lo, least(l.hi, r.hi) AS hi FROM sp l JOIN sp r ON r.curve = l.curve + 1 WHERE l.curve % 2 = 0 AND least(l.hi, r.hi) > greatest(l.lo, r.lo)),
 gx AS (SELECT pair, lft, rgt, i, lo + (hi - lo) * i / 119 AS gx FROM g CROSS JOIN (SELECT unnest(range(0, 120)) AS i)),
 pr AS (SELECT pair, i, gx, lft AS curve, 'l' AS side FROM gx UNION ALL SELECT pair, i, gx, rgt, 'r' FROM gx),
 br AS (SELECT pair, i, gx, side, max(CASE WHEN x <= gx THEN x END) AS x0, arg_max(y, CASE WHEN x <= gx THEN x END) AS y0, min(CASE WHEN x >= gx THEN x END) AS x1, arg_min(y, CASE WHEN x >= gx THEN x END) AS y1 FROM pr JOIN cl USING (curve) GROUP BY 1, 2, 3, 4),
 vv AS (SELECT pair, i, gx, side, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x1 > x0 THEN y0 + (y1 - y0) * (gx - x0) / (x1 - x0) ELSE y0 END AS v FROM br),
 grid AS (SELECT pair, i, gx, max(CASE WHEN side = 'l' THEN v END) AS left_value, max(CASE WHEN side = 'r' THEN v END) AS right_value FROM vv GROUP BY 1, 2, 3)"""

QUERIES = {
    "axis_fit_auto": (lambda s, d: _fit(A.fit_axes(_shaped(s, d))), _fit_sql(_SHAPED, "['linear', 'log10']", 1.5, 0.03)),
    "axis_fit_linear": (lambda s, d: _fit(A.fit_axes(order_ticks(s, d), "linear", span_share=0.3)), _fit_sql("SELECT * FROM ticks", "['linear']", 1.5, 0.3)),
    "axis_fit_log": (lambda s, d: _fit(A.fit_axes(_shaped(s, d).withColumn("value", F.col("value") - F.when(F.col("axis") % 6 == 0, 5.0).otherwise(0.0)), "log10")), _fit_sql(f"SELECT axis, pixel, value - CASE WHEN axis % 6 = 0 THEN 5.0 ELSE 0 END AS value FROM ({_SHAPED})", "['log10']", 1.5, 0.03, "WHEN NOT pos THEN 'log_needs_positive'")),
    "axis_fit_policy": (lambda s, d: _round(A.fit_policy(_shaped(s, d), 4, 0.02), m=6), f"WITH {TICKS}, src AS (SELECT DISTINCT * FROM ({_SHAPED})), ln AS (SELECT axis, count(*) AS n_ticks, regr_slope(value, pixel) AS m, regr_intercept(value, pixel) AS b, max(value) - min(value) AS span FROM src GROUP BY 1), e AS (SELECT axis, max(abs(m * pixel + b - value)) AS max_error FROM src JOIN ln USING (axis) GROUP BY 1) SELECT axis, n_ticks, round(CASE WHEN n_ticks > 1 THEN m END, 6) AS m, round(CASE WHEN n_ticks > 1 THEN b END, 4) AS b, round(CASE WHEN n_ticks > 1 THEN max_error END, 4) AS max_error, CASE WHEN n_ticks < 4 THEN 'too_few_ticks' WHEN abs(coalesce(m, 0)) < 1e-9 THEN 'no_candidate' WHEN max_error > 0.02 * span THEN 'residual_untrusted' ELSE 'ok' END AS status FROM ln JOIN e USING (axis)"),
    "axis_values": (lambda s, d: _round(A.fit_axes(_shaped(s, d)).where("status = 'ok'").join(_shaped(s, d), "axis").select("axis", "pixel", A.value_at(F.col("pixel") + 7, F.col("model"), F.col("m"), F.col("b")).alias("at"), A.pixel_at(F.col("value"), F.col("model"), F.col("m"), F.col("b")).alias("back"), A.clipped_value(F.col("pixel") * 2, F.lit(40.0), F.lit(280.0), F.lit(1.0), F.lit(100.0), F.col("model") == "log10").alias("clipped")), at=6, back=6, clipped=6), _fit_sql(_SHAPED, "['linear', 'log10']", 1.5, 0.03).replace(" SELECT axis, status, n_ticks, CASE WHEN status = 'ok' THEN model END AS model, round(CASE WHEN status = 'ok' THEN m END, 6) AS m, round(CASE WHEN status = 'ok' THEN b END, 4) AS b, round(residual_px, 3) AS residual_px, round(runner_up_px, 3) AS runner_up_px FROM st", " SELECT axis, pixel, round(CASE WHEN model = 'log10' THEN pow(10, m * (pixel + 7) + b) ELSE m * (pixel + 7) + b END, 6) AS at, round((CASE WHEN model = 'log10' THEN log10(value) ELSE value END - b) / m, 6) AS back, round(CASE WHEN model = 'log10' THEN pow(10, 2 * greatest(0, least(1, (pixel * 2 - 40) / 240))) ELSE 1 + 99 * greatest(0, least(1, (pixel * 2 - 40) / 240)) END, 6) AS clipped FROM st JOIN src USING (axis) WHERE status = 'ok'")),
    "axis_maximal_runs": (lambda s, d: _round(A.maximal_linear_runs(order_ticks(s, d).groupBy("axis", "pixel").agg(F.min("value").alias("value")), 2, 3.0, 0.3), rms=3), f"""WITH {TICKS}, u AS (SELECT axis, pixel, min(value) AS value FROM ticks GROUP BY 1, 2), t AS (SELECT *, row_number() OVER w AS i, value - lag(value) OVER w AS dv FROM u WINDOW w AS (PARTITION BY axis ORDER BY pixel, value)),
 r AS (SELECT a.axis, a.i AS start, b.i AS stop, abs(b.value - a.value) / (b.i - a.i) AS step FROM t a JOIN t b ON a.axis = b.axis AND b.i > a.i),
 f AS (SELECT r.axis, start, stop, step, count(*) FILTER (i > start AND dv > 0) AS up, count(*) FILTER (i > start AND dv < 0) AS down, sqrt(greatest(regr_syy(value, pixel) - CASE WHEN regr_sxx(value, pixel) > 1e-12 THEN regr_sxy(value, pixel) * regr_sxy(value, pixel) / regr_sxx(value, pixel) ELSE 0 END, 0) / count(*)) AS rms FROM r JOIN t ON t.axis = r.axis AND i BETWEEN start AND stop GROUP BY 1, 2, 3, 4),
 ok AS (SELECT axis, start, stop, rms FROM f WHERE (up = stop - start OR down = stop - start) AND rms <= greatest(3.0, 0.3 * step))
 SELECT axis, start, stop, round(rms, 3) AS rms FROM ok o WHERE NOT EXISTS (SELECT 1 FROM ok q WHERE q.axis = o.axis AND q.start <= o.start AND q.stop >= o.stop AND (q.start < o.start OR q.stop > o.stop))"""),
    "axis_consensus": (lambda s, d: _round(A.consensus_fit(_shaped(s, d), 2.0), m=7, b=7), f"""WITH {TICKS}, src AS (SELECT DISTINCT * FROM ({_SHAPED})), pa AS (SELECT a.axis, a.pixel AS pa, a.value AS va, b.pixel AS pb, b.value AS vb, (b.value - a.value) / (b.pixel - a.pixel) AS m0, a.value - (b.value - a.value) / (b.pixel - a.pixel) * a.pixel AS b0 FROM src a JOIN src b ON a.axis = b.axis AND a.pixel < b.pixel AND a.value <> b.value),
 f AS (SELECT p.axis, pa, va, pb, vb, count(*) AS n_inliers, max(pixel) - min(pixel) AS span_px, regr_slope(value, pixel) AS m, regr_intercept(value, pixel) AS b, round(greatest(regr_syy(value, pixel) - regr_sxy(value, pixel) * regr_sxy(value, pixel) / nullif(regr_sxx(value, pixel), 0), 0), 6) AS sse FROM pa p JOIN src s ON s.axis = p.axis AND abs(m0 * pixel + b0 - value) <= 2.0 GROUP BY 1, 2, 3, 4, 5)
 SELECT axis, n_inliers, span_px, round(m, 7) AS m, round(b, 7) AS b FROM f QUALIFY row_number() OVER (PARTITION BY axis ORDER BY n_inliers DESC, span_px DESC, sse, pa, va, pb, vb) = 1"""),
    "axis_drop_offset": (lambda s, d: _round(A.drop_offset_tick(_shaped(s, d).withColumn("value", F.col("value") + F.when((F.col("axis") % 3 == 0) & (F.col("pixel") == 80), 9.0).otherwise(0.0)), 4), rms_all=3, rms_left=3), f"""WITH {TICKS}, src AS (SELECT axis, pixel, value + CASE WHEN axis % 3 = 0 AND pixel = 80 THEN 9.0 ELSE 0 END AS value FROM ({_SHAPED})), t AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY pixel, value) AS i, count(*) OVER (PARTITION BY axis) AS n FROM src QUALIFY n >= 4),
 al AS (SELECT axis, sqrt(greatest(regr_syy(value, pixel) - regr_sxy(value, pixel) * regr_sxy(value, pixel) / regr_sxx(value, pixel), 0) / count(*)) AS rms_all FROM t GROUP BY 1),
 ou AS (SELECT a.axis, a.i AS dr, sqrt(greatest(regr_syy(b.value, b.pixel) - regr_sxy(b.value, b.pixel) * regr_sxy(b.value, b.pixel) / regr_sxx(b.value, b.pixel), 0) / count(*)) AS rms_left FROM t a JOIN t b ON a.axis = b.axis AND a.i <> b.i GROUP BY 1, 2)
 SELECT axis, CASE WHEN round(rms_all, 6) >= 3 * round(rms_left, 6) + 1e-6 THEN dr END AS dropped, round(rms_all, 3) AS rms_all, round(rms_left, 3) AS rms_left FROM ou JOIN al USING (axis) QUALIFY row_number() OVER (PARTITION BY axis ORDER BY round(rms_left, 6), dr) = 1"""),
    "axis_one_tick_a_value": (lambda s, d: A.one_tick_a_value(order_ticks(s, d)), f"WITH {TICKS}, l AS (SELECT axis, regr_slope(value, pixel) AS m, regr_intercept(value, pixel) AS b FROM ticks GROUP BY 1) SELECT axis, pixel, value FROM ticks JOIN l USING (axis) QUALIFY row_number() OVER (PARTITION BY axis, value ORDER BY round(abs(m * pixel + b - value), 9), pixel) = 1"),
    "axis_uniform_run": (lambda s, d: A.uniform_run(order_ticks(s, d).groupBy("axis", "pixel").agg(F.min("value").alias("value")).select("axis", (F.col("pixel") / 40).cast("int").alias("i"), (F.col("value") - F.min("value").over(A.by_axis())).alias("value"))), f"WITH {TICKS}, u AS (SELECT axis, CAST(pixel / 40 AS INT) AS i, min(value) AS v FROM ticks GROUP BY 1, 2), z AS (SELECT axis, i, v - min(v) OVER (PARTITION BY axis) AS value FROM u), t AS (SELECT *, value - lag(value) OVER w AS dv FROM z WINDOW w AS (PARTITION BY axis ORDER BY i)), n AS (SELECT *, CASE WHEN value = 0 OR NOT coalesce(dv > 0, false) THEN 1 ELSE 0 END AS new FROM t), r AS (SELECT *, sum(new) OVER (PARTITION BY axis ORDER BY i ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN new = 0 THEN dv END AS din FROM n), g AS (SELECT axis, run, min(value) AS f, max(value) AS last, count(*) AS n, stddev_pop(din) AS sd, median(din) AS md, CAST(min(i) AS BIGINT) AS start FROM r GROUP BY 1, 2 HAVING min(value) = 0) SELECT axis, start, n, last, coalesce(sd <= greatest(0.05, 0.15 * md), false) AS uniform FROM g QUALIFY row_number() OVER (PARTITION BY axis ORDER BY n DESC, start) = 1"),
    "axis_snap_to_grid": (lambda s, d: A.snap_to_grid(order_ticks(s, d), order_ticks(s, d).select("axis").distinct().select("axis", F.explode(F.array(*[F.lit(45.0 * k) for k in range(1, 8)])).alias("rail")), 15.0), f"WITH {TICKS}, t AS (SELECT * FROM ticks), d AS (SELECT axis, pixel, value, k * 45.0 AS rail, abs(pixel - k * 45.0) AS dd FROM t CROSS JOIN (SELECT unnest(range(1, 8)) AS k) WHERE abs(pixel - k * 45.0) <= 15), m AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY axis, pixel, value ORDER BY dd, rail) = 1) SELECT axis, pixel, value, CAST(rail AS DOUBLE) AS snapped FROM m QUALIFY row_number() OVER (PARTITION BY axis, rail ORDER BY dd, pixel, value) = 1"),
    "interp_inside": (lambda s, d: _round(I.interp_inside(_clean(s, d), _probes(s, d)), value=3), _BRACKET + " SELECT curve, px, round(CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN lerp END, 3) AS value FROM v"),
    "interp_near": (lambda s, d: _round(I.interp_near(_clean(s, d), _probes(s, d), 15.0), value=3), _BRACKET + " SELECT curve, px, round(CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL AND x1 - x0 <= 15 THEN lerp END, 3) AS value, CASE WHEN x0 IS NULL OR x1 IS NULL THEN 'outside_span' WHEN x1 - x0 > 15 THEN 'inside_gap' END AS reason FROM v"),
    "interp_clamped": (lambda s, d: _round(I.interp_clamped(_clean(s, d), _probes(s, d)), value=3), _BRACKET + " SELECT curve, px, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE lerp END, 3) AS value FROM v"),
    "matched_grid": (lambda s, d: _round(_grid(s, d), gx=3, left_value=2, right_value=2), _GRID + " SELECT pair, i, round(gx, 3) AS gx, round(left_value, 2) AS left_value, round(right_value, 2) AS right_value FROM grid"),
    "pairwise_collapse": (lambda s, d: _round(I.collapse(_grid(s, d), 10.0)), _GRID + ", s AS (SELECT *, abs(left_value - right_value) <= 10 AS same FROM grid), r AS (SELECT *, i - sum(same::INT) OVER (PARTITION BY pair ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s), rr AS (SELECT pair, run, count(*) FILTER (same) AS n, count(*) AS al FROM r GROUP BY 1, 2) SELECT pair, round(sum(n) / sum(al), 4) AS collapse_fraction, max(n) AS longest_run FROM rr GROUP BY 1"),
}
