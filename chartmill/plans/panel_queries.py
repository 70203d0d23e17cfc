"""Queries of strokes, exports, trace checks, axis evidence, table rows and temperature identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as G
from ..operators import anchors as A
from ..operators import closure as K
from ..operators import panels as P
from ..operators import validate as V
from ..session import table
from .adapters import CLEAN, POINTS, event_points
from .curve_queries import _clean, _round

NAMES = ("view", "click", "purchase")


def _exported(s, d):
    x, y = F.floor("x").cast("double"), F.round("y")
    box = {k: F.lit(v) for k, v in (("x0", 20.0), ("y0", 10.0), ("x1", 740.0), ("y1", 510.0))}
    return _round(_clean(s, d).select("curve", "x", *[c.alias(n) for n, c in P.exported(x, y, box).items()]), x_norm=6, y_norm=6)


def _cubics(s, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    c = {"ax": k % 50, "ay": z, "bx": k % 50 + z, "by": z + 30, "cx": k % 50 + 40, "cy": z - k % 20, "dx": k % 50 + 60, "dy": z + k % 9}
    return _round(P.cubic_points(table(s, d, "part").select(k.alias("id"), *[v.cast("double").alias(n) for n, v in c.items()])), x=9, y=9)


_CUBICS = """WITH c AS (SELECT p_partkey AS id, p_partkey % 50 AS ax, p_size AS ay, p_partkey % 50 + p_size AS bx, p_size + 30 AS b_y, p_partkey % 50 + 40 AS cx, p_size - p_partkey % 20 AS cy, p_partkey % 50 + 60 AS dx, p_size + p_partkey % 9 AS dy FROM part),
 t AS (SELECT *, i / 12.0::DOUBLE AS t FROM c CROSS JOIN (SELECT CAST(unnest(range(0, 13)) AS INT) AS i)) SELECT id, i, round(pow(1 - t, 3) * ax + 3 * pow(1 - t, 2) * t * bx + 3 * (1 - t) * t * t * cx + pow(t, 3) * dx, 9) AS x, round(pow(1 - t, 3) * ay + 3 * pow(1 - t, 2) * t * b_y + 3 * (1 - t) * t * t * cy + pow(t, 3) * dy, 9) AS y FROM t"""


def _strokes(s, d):
    """lineitem as drawn strokes: an order is a panel; every fifth stroke lies on the frame."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    on = k % 5 == 0
    li = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("panel"), k.alias("id"), n.alias("line"), F.when(F.col("l_returnflag") == "R", "f").otherwise("s").alias("kind"), (F.col("l_tax") * 30).alias("width"),
        (F.col("l_discount") * 10).alias("red"), (k % 10 / 10.0).alias("green"), (F.col("l_suppkey") % 10 / 10.0).alias("blue"),
        F.when(on, 10.0).otherwise(k % 220).alias("x0"), F.when(on, 20.0).otherwise(k % 90 * 1.0).alias("y0"), F.when(on, 200.0).otherwise(k % 220 + n * 5.0).alias("x1"), F.when(on, 20.0).otherwise(k % 90 + n * 3.0).alias("y1"),
    )
    frame = {"left": 10.0, "top": 20.0, "right": 210.0, "bottom": 120.0}
    return P.curve_strokes(li.withColumns({c: F.lit(v) for c, v in frame.items()})).select("panel", "id", "line", F.round("width", 4).alias("width"))


_STROKES = """WITH s AS (SELECT l_orderkey AS panel, l_partkey AS id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'f' ELSE 's' END AS kind, l_tax * 30 AS width, l_discount * 10 AS r, l_partkey % 10 / 10.0::DOUBLE AS g, l_suppkey % 10 / 10.0::DOUBLE AS b,
 CASE WHEN l_partkey % 5 = 0 THEN 10.0 ELSE l_partkey % 220 END::DOUBLE AS x0, CASE WHEN l_partkey % 5 = 0 THEN 20.0 ELSE l_partkey % 90 END::DOUBLE AS y0, CASE WHEN l_partkey % 5 = 0 THEN 200.0 ELSE l_partkey % 220 + l_linenumber * 5 END::DOUBLE AS x1, CASE WHEN l_partkey % 5 = 0 THEN 20.0 ELSE l_partkey % 90 + l_linenumber * 3 END::DOUBLE AS y1 FROM lineitem)
 SELECT panel, id, line, round(width, 4) AS width FROM s WHERE kind = 's' AND width BETWEEN 0.8 AND 2.2 AND (greatest(r, g, b) < 0.22 OR greatest(r, g, b) - least(r, g, b) >= 0.15) AND (x0 + x1) / 2 BETWEEN 7 AND 213 AND (y0 + y1) / 2 BETWEEN 17 AND 123
 AND NOT ((abs(y1 - y0) < 0.1 AND abs(x1 - x0) > 90 AND (abs((y0 + y1) / 2 - 20) <= 1.5 OR abs((y0 + y1) / 2 - 120) <= 1.5)) OR (abs(x1 - x0) < 0.1 AND abs(y1 - y0) > 45 AND (abs((x0 + x1) / 2 - 10) <= 1.5 OR abs((x0 + x1) / 2 - 210) <= 1.5)))"""


def _pixels(s, d):
    c = _clean(s, d)
    pts = c.select("curve", F.col("x").alias("i"), F.floor(F.col("x") / 3).cast("long").alias("x"), F.round(F.col("y") / 4).cast("long").alias("y"))
    boxes = c.select("curve").distinct().select("curve", *[F.lit(v).alias(n) for n, v in (("x0", 0), ("y0", 0), ("x1", 240), ("y1", 125))])
    return P.pixel_columns(pts, boxes)


_PIXELS = f"""WITH {CLEAN}, p AS (SELECT curve, x AS i, CAST(floor(x / 3) AS BIGINT) AS x, CAST(round(y / 4) AS BIGINT) AS y FROM cl), n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM p WINDOW w AS (PARTITION BY curve ORDER BY i)),
 g AS (SELECT *, greatest(1, greatest(abs(nx - x), abs(ny - y))) AS m FROM n WHERE nx IS NOT NULL AND NOT (nx = x AND ny = y) AND NOT (abs(nx - x) > 0.08 * 240 AND abs(ny - y) > 0.25 * 125)),
 k AS (SELECT *, unnest(range(0, m + 1)) AS k FROM g), s AS (SELECT curve, CAST(round_even(x + (nx - x) * (k / m::DOUBLE), 0) AS BIGINT) AS x, CAST(round_even(y + (ny - y) * (k / m::DOUBLE), 0) AS BIGINT) AS y FROM k)
 SELECT curve, x, CAST(CASE WHEN count(*) >= 4 AND x <= 0.12 * 240 THEN min(y) ELSE round_even(median(y), 0) END AS BIGINT) AS y FROM s WHERE x BETWEEN -4 AND 244 AND y BETWEEN -4 AND 129 GROUP BY curve, x"""


def _checks(s, d):
    p = event_points(s, d).where("y IS NOT NULL").select((F.col("curve") % 400).alias("panel"), "trace", F.floor(F.col("x") / 6).cast("long").alias("x"), F.round(F.col("y") / 2).cast("long").alias("y"))
    return _round(P.trace_checks(p, NAMES))


_CHECKS = f"""WITH {POINTS}, p AS (SELECT curve % 400 AS panel, trace, CAST(floor(x / 6) AS BIGINT) AS x, CAST(round(y / 2) AS BIGINT) AS y FROM pts WHERE y IS NOT NULL AND trace IN ('view', 'click', 'purchase')), m AS (SELECT panel, trace, x, median(y) AS y FROM p GROUP BY 1, 2, 3),
 sp AS (SELECT panel, trace, min(x) AS lo, max(x) AS hi, max(y) - min(y) AS rg FROM p GROUP BY 1, 2), g AS (SELECT panel, max(lo) AS lo, min(hi) AS hi, max(rg) FILTER (trace = 'view') AS r1, max(rg) FILTER (trace = 'click') AS r2 FROM sp GROUP BY 1 HAVING count(*) = 3),
 a AS (SELECT panel, unnest(range(lo, hi + 1, greatest(1, (hi - lo) // 200))) AS px FROM g WHERE hi >= lo), t AS (SELECT * FROM a CROSS JOIN (SELECT unnest(['view', 'click', 'purchase']) AS trace)), n AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM m WINDOW w AS (PARTITION BY panel, trace ORDER BY x)),
 v AS (SELECT t.panel, t.px, t.trace, CASE WHEN nx IS NULL OR nx = n.x THEN y ELSE y + (ny - y) * (px - n.x) / (nx - n.x) END AS v FROM t ASOF JOIN n ON n.panel = t.panel AND n.trace = t.trace AND t.px >= n.x),
 w AS (SELECT panel, px, max(v) FILTER (trace = 'view') AS v0, max(v) FILTER (trace = 'click') AS v1, max(v) FILTER (trace = 'purchase') AS v2 FROM v GROUP BY 1, 2), b AS (SELECT panel, count(*) AS n, avg(CASE WHEN v2 >= greatest(v0, v1) THEN 1.0 ELSE 0.0 END) AS bottom FROM w GROUP BY 1),
 d AS (SELECT panel, x, sign(max(y) FILTER (trace = 'view') - max(y) FILTER (trace = 'click')) AS sg FROM m GROUP BY 1, 2), e AS (SELECT panel, CASE WHEN sg <> lag(sg) OVER (PARTITION BY panel ORDER BY x) THEN 1 ELSE 0 END AS sw FROM d WHERE sg <> 0), f AS (SELECT panel, sum(sw) AS swaps FROM e GROUP BY 1)
 SELECT g.panel, coalesce(n, 0) AS common_samples, CAST(coalesce(swaps, 0) AS BIGINT) AS rank_swaps, round(coalesce(bottom, 0), 4) AS crss_bottom, r1 < r2 AS ciss_flatter FROM g LEFT JOIN b USING (panel) LEFT JOIN f USING (panel)"""


def _collapse(s, d):
    p = event_points(s, d).where("y IS NOT NULL").groupBy(F.col("curve").alias("panel"), "trace", F.floor(F.col("x") / 12).cast("long").alias("row")).agg(F.round(F.max("y") / 10).alias("x"))
    return _round(P.pairwise_collapse(p))


_COLLAPSE = f"""WITH {POINTS}, p AS (SELECT curve AS panel, trace, CAST(floor(x / 12) AS BIGINT) AS r, round(max(y) / 10) AS x FROM pts WHERE y IS NOT NULL GROUP BY 1, 2, 3), sp AS (SELECT panel, trace, min(r) AS lo, max(r) AS hi FROM p GROUP BY 1, 2),
 pr AS (SELECT a.panel, a.trace AS f, b.trace AS s, unnest(range(greatest(a.lo, b.lo), least(a.hi, b.hi) + 1)) AS r FROM sp a JOIN sp b ON a.panel = b.panel AND a.trace < b.trace WHERE least(a.hi, b.hi) >= greatest(a.lo, b.lo)),
 n AS (SELECT *, lead(r) OVER w AS nr, lead(x) OVER w AS nx FROM p WINDOW w AS (PARTITION BY panel, trace ORDER BY r)),
 u AS (SELECT pr.panel, f, s, pr.r, CASE WHEN nr IS NULL THEN x ELSE x + (nx - x) * (pr.r - n.r) / (nr - n.r) END AS a FROM pr ASOF JOIN n ON n.panel = pr.panel AND n.trace = pr.f AND pr.r >= n.r),
 v AS (SELECT u.panel, f, s, u.r, a, CASE WHEN nr IS NULL THEN x ELSE x + (nx - x) * (u.r - n.r) / (nr - n.r) END AS b FROM u ASOF JOIN n ON n.panel = u.panel AND n.trace = u.s AND u.r >= n.r)
 SELECT panel, f AS "first", s AS "second", count(*) AS "rows", round(avg(CASE WHEN abs(a - b) <= 1.5 THEN 1.0 ELSE 0.0 END), 4) AS collapsed FROM v GROUP BY 1, 2, 3"""


def _families(s, d):
    """Transfer curves of a part at three temperatures: hotter ones start further left; every ninth part's cross, every eleventh lacks a label."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("panel"), "p_size", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("curve"))
    k = F.when((F.col("panel") % 9 == 0) & (F.col("curve") == 2), 0.3).otherwise(2.0)
    c = p.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20)))).withColumn("i", F.col("n") * 0.5).select("panel", "curve", (2 + F.col("p_size") / 50 + F.col("curve") * 0.2 + F.sqrt(F.col("i") / k)).alias("v"), "i")
    t = p.where((F.col("panel") % 11 != 0) | (F.col("curve") < 3)).select("panel", (F.col("curve") * 50.0 - 25).alias("tj"))
    return P.ranked_temperatures(c, t)


_FAMILIES = """WITH p AS (SELECT p_partkey AS panel, p_size, c AS curve FROM part CROSS JOIN (SELECT CAST(unnest(range(1, 4)) AS INT) AS c)), q AS (SELECT panel, curve, 2 + p_size / 50.0::DOUBLE + curve * 0.2::DOUBLE AS v0, CASE WHEN panel % 9 = 0 AND curve = 2 THEN 0.3 ELSE 2.0 END::DOUBLE AS k FROM p),
 pt AS (SELECT panel, curve, i * 0.5::DOUBLE AS i, v0 + sqrt(i * 0.5 / k) AS v FROM q CROSS JOIN (SELECT unnest(range(1, 21)) AS i)),
 a AS (SELECT panel, curve, j, c FROM q CROSS JOIN (VALUES (0, 1.2::DOUBLE), (1, 1.8::DOUBLE)) AS z(j, c)), n AS (SELECT *, lead(i) OVER w AS ni, lead(v) OVER w AS nv FROM pt WINDOW w AS (PARTITION BY panel, curve ORDER BY i)),
 r AS (SELECT a.panel, a.curve, j, v + (nv - v) * (c - i) / (ni - i) AS g FROM a JOIN n ON n.panel = a.panel AND n.curve = a.curve AND c >= i AND c < ni), k AS (SELECT *, row_number() OVER (PARTITION BY panel, j ORDER BY g, curve) AS rk FROM r),
 b AS (SELECT panel, curve, max(rk) FILTER (j = 0) AS r0, max(rk) FILTER (j = 1) AS r1 FROM k GROUP BY 1, 2), m AS (SELECT panel, bool_or(r0 <> r1) AS moved FROM b GROUP BY 1),
 s AS (SELECT panel, CASE WHEN panel % 11 = 0 THEN 'count_mismatch' WHEN moved THEN 'order_changes' ELSE 'ok' END AS status FROM m) SELECT panel, curve, CASE WHEN status = 'ok' THEN 175.0::DOUBLE - 50.0 * r0 END AS tj, status FROM b JOIN s USING (panel)"""


def _gate_ticks(s, d):
    """lineitem as gate-voltage labels of orders: most on one line, some misread, on every thirteenth order upside down."""
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("axis"), F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("l_partkey")).select("axis", F.when(F.col("l_partkey") % 7 == 0, F.col("line") * 2.0 + 2).otherwise(F.col("line") * 2.0).alias("value"), F.when(F.col("axis") % 13 == 0, F.col("line") * 30.0).otherwise(400 - F.col("line") * 30.0).alias("y"))


_GATE = "t AS (SELECT axis, CASE WHEN pk % 7 = 0 THEN line * 2.0 + 2 ELSE line * 2.0 END::DOUBLE AS value, CASE WHEN axis % 13 = 0 THEN line * 30.0 ELSE 400 - line * 30.0 END::DOUBLE AS y FROM (SELECT l_orderkey AS axis, l_linenumber AS line, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2))"
_EVIDENCE = f"""WITH {_GATE}, l AS (SELECT axis, count(*) AS n, regr_slope(value, y) AS m, regr_intercept(value, y) AS b, max(value) - min(value) AS sp, max(y) - min(y) AS rw, min(value) AS lo, max(value) AS hi FROM t GROUP BY 1), o AS (SELECT t.*, abs(value - (m * y + b)) AS off FROM t JOIN l USING (axis)), w AS (SELECT axis, max(off) AS worst FROM o GROUP BY 1),
 q AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY axis, value ORDER BY round(off, 9), y) = 1), f AS (SELECT axis, count(*) AS n, regr_slope(value, y) AS m, regr_intercept(value, y) AS b, max(value) - min(value) AS sp, max(y) - min(y) AS rw FROM q GROUP BY 1), z AS (SELECT q.axis, max(abs(value - (m * y + b))) AS off FROM q JOIN f USING (axis) GROUP BY 1)
 SELECT l.axis, l.n, coalesce(l.n >= 2 AND l.sp >= 1 AND l.rw >= 15 AND l.m < 0 AND worst <= greatest(0.25, 0.06 * l.sp) AND lo >= -20 AND hi <= 30, false) AS evidenced, CASE WHEN f.n >= 2 THEN f.n ELSE 0 END AS quality_n, round(CASE WHEN f.n >= 2 THEN -z.off / greatest(1, f.sp) ELSE -1e9 END, 6) + 0.0 AS quality_fit, CASE WHEN f.n >= 2 THEN f.rw ELSE 0 END AS quality_rows, CASE WHEN f.n >= 2 THEN f.sp ELSE 0 END AS quality_span FROM l JOIN w USING (axis) JOIN f USING (axis) LEFT JOIN z USING (axis)"""


def _rows_of_tables(s, d):
    """part as text boxes in ruled tables: pages of 20 rows, 18 points apart; every fourth box is too high for its row."""
    k = F.col("p_partkey")
    p = table(s, d, "part").select(F.floor(k / 20).alias("page"), k.alias("id"), (k % 20 * 18.0).alias("y"), "p_size", "p_brand")
    boxes = p.select("page", "id", F.lit(40.0).alias("x0"), (F.col("y") + 3).alias("y0"), (100.0 + F.col("p_size")).alias("x1"), (F.col("y") + F.when(F.col("id") % 4 == 0, 30).otherwise(14)).alias("y1"))
    rules = p.where("id % 3 <> 0").select("page", F.lit(30.0).alias("x0"), "y", F.when(F.col("id") % 10 == 1, 60.0).otherwise(400.0).alias("x1"))
    words = p.select("page", F.explode(F.array(F.col("p_size").cast("string"), (F.col("id") % 7 + 0.5).cast("string"), F.when(F.col("id") % 2 == 0, "nC").otherwise("Fig."))).alias("text"), (F.col("y") + 9).alias("cy"))
    return P.table_rows(boxes, rules, words)


_ROWS = """WITH p AS (SELECT p_partkey // 20 AS page, p_partkey AS id, p_partkey % 20 * 18.0::DOUBLE AS y, p_size FROM part), b AS (SELECT page, id, 40.0 AS x0, y + 3 AS y0, 100.0 + p_size AS x1, y + CASE WHEN id % 4 = 0 THEN 30 ELSE 14 END AS y1 FROM p), r AS (SELECT page, y, 30.0 AS x0, CASE WHEN id % 10 = 1 THEN 60.0 ELSE 400.0 END AS x1 FROM p WHERE id % 3 <> 0),
 n AS (SELECT b.*, r.y FROM b JOIN r USING (page) WHERE b.y1 - b.y0 BETWEEN 3 AND 36 AND r.x1 - r.x0 >= greatest(60, 0.4 * (b.x1 - b.x0)) AND (b.x0 + b.x1) / 2 BETWEEN r.x0 AND r.x1 AND r.y BETWEEN b.y0 - 4 AND b.y1 + 4), s AS (SELECT DISTINCT u.page, u.id FROM n u JOIN n l ON l.id = u.id WHERE u.y <= u.y0 + 0.5 * (u.y1 - u.y0) + 1 AND l.y >= l.y1 AND l.y - u.y BETWEEN 5 AND 28),
 w AS (SELECT page, y + 9 AS cy, CAST(p_size AS VARCHAR) AS text FROM p UNION ALL SELECT page, y + 9, CAST(id % 7 + 0.5 AS VARCHAR) FROM p UNION ALL SELECT page, y + 9, CASE WHEN id % 2 = 0 THEN 'nC' ELSE 'Fig.' END FROM p),
 c AS (SELECT b.page, b.id, count(*) FILTER (regexp_full_match(w.text, '[+-]?\\d+(?:\\.\\d+)?')) >= 2 AND bool_or(w.text = 'nC') AS ok FROM b JOIN s USING (page, id) JOIN w ON w.page = b.page AND w.cy BETWEEN b.y0 - 5 AND b.y1 + 5 GROUP BY 1, 2)
 SELECT b.page, b.id, s.id IS NOT NULL AS shallow, coalesce(c.ok, false) AS crossref FROM b LEFT JOIN s USING (page, id) LEFT JOIN c USING (page, id)"""


def _tsv(s, d):
    """Orders as pages of recognised words: a header line and one line an item; some without text or with a broken number."""
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("k"))
    row = F.concat_ws("\t", F.when(F.col("k") % 6 == 0, "n/a").otherwise((F.col("k") % 300).cast("string")), (F.col("n") * 20).cast("string"), (F.col("q") + 10).cast("string"), F.lit("12"), (F.col("k") % 100).cast("string"), F.when(F.col("k") % 5 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("k").cast("string"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("r")))), lambda x: x["r"]), "\n")
    pages = li.groupBy("page").agg(F.concat(F.lit("left\ttop\twidth\theight\tconf\ttext\n"), body).alias("tsv")).withColumns({"width_pt": F.lit(595.0), "height_pt": F.lit(842.0), "width_px": F.lit(1190), "height_px": F.lit(1684)})
    return _round(P.ocr_words(pages))


_TSV_ROWS = """WITH li AS (SELECT l_orderkey AS page, l_linenumber AS n, min(l_quantity) AS q, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2) SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY n) AS INT) AS line, k, q, n FROM li"""
_TSV = f"WITH r AS ({_TSV_ROWS}) SELECT page, line, concat('w', k) AS text, round(k % 300 * 0.5::DOUBLE, 4) AS x0, round(n * 10.0::DOUBLE, 4) AS y0, round((k % 300 + q + 10) * 0.5::DOUBLE, 4) AS x1, round((n * 20 + 12) * 0.5::DOUBLE, 4) AS y1 FROM r WHERE k % 6 <> 0 AND k % 5 <> 0 AND k % 100 >= 10"


def _json(s, d):
    e = table(s, d, "events")
    text = F.when(F.col("event_id") % 9 == 0, F.lit('{"k": NaN}')).when(F.col("event_id") % 9 == 1, F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.lit(', "note": "NaN"}'))).when(F.col("event_id") % 9 == 2, F.lit('{"k": -Infinity}')).otherwise(F.col("props"))
    return e.select("event_id", P.strict_json(text, "k long").getField("k").alias("k"))


def _resistance(s, d, kind):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    num = lambda m, scale, off=0.0: (k * m % 89) / F.lit(89.0) * scale + off
    cols = {"n_curves": k % 10, "identity": k % 8 != 0, "x_residual": num(7, 1.8), "y_residual": num(11, 1.6), "x_span": num(13, 0.5, 0.5), "y_range": num(17, 0.6, 0.05), "at_25": F.when(k % 7 != 0, num(19, 0.2, 0.9)), "largest_fall": num(23, 0.06), "typ_25": num(29, 4.0, 2), "max_25": num(31, 4.0, 4)}
    return o.select(k.alias("id"), *[v.alias(n) for n, v in cols.items()]).select("id", F.array_join(V.resistance_reasons(kind), ",").alias("reasons"))


def _resistance_sql(kind: str) -> str:
    num = lambda m, scale, off=0.0: f"(o_orderkey * {m} % 89) / 89.0::DOUBLE * {scale} + {off}"
    over = kind == "current"
    cols = f"o_orderkey AS id, o_orderkey % 10 AS n, o_orderkey % 8 <> 0 AS ident, greatest({num(7, 1.8)}, {num(11, 1.6)}) AS res, {num(13, 0.5, 0.5)} AS xs, {num(17, 0.6, 0.05)} AS yr, CASE WHEN o_orderkey % 7 <> 0 THEN {num(19, 0.2, 0.9)} END AS a, {num(23, 0.06)} AS fall, {num(29, 4.0, 2)} AS ty, {num(31, 4.0, 4)} AS mx"
    flat, least = {"normalized": ("normalized_rds_span_below_threshold", 0.15), "absolute": ("absolute_rds_span_below_threshold", 0.15), "current": ("rdson_span_below_threshold", 0.20)}[kind]
    rules = [f"CASE WHEN NOT ident THEN '{'rdson_current' if over else 'temperature'}_axis_identity_unverified' END", "CASE WHEN res > 1.5 THEN 'axis_residual_exceeds_threshold' END", f"CASE WHEN xs < 0.7 THEN '{'drain_current' if over else 'temperature'}_span_below_threshold' END", f"CASE WHEN yr < {least} THEN '{flat}' END"]
    rules += [] if over else ["CASE WHEN a IS NULL THEN 'reference_temperature_not_bracketed' END"]
    rules += ["CASE WHEN abs(a - 1) > 0.06 THEN 'normalized_rds_at_reference_outside_tolerance' END"] if kind == "normalized" else []
    rules += [f"CASE WHEN fall > {0.035 if over else 0.03} THEN '{'rdson_not_nondecreasing_with_drain_current' if over else 'normalized_rds_not_nondecreasing_with_temperature'}' END"]
    rules += ["CASE WHEN mx <= ty THEN 'absolute_rds_typ_max_curve_order_unverified' END"] if kind == "absolute" else []
    return f"WITH t AS (SELECT {cols} FROM orders) SELECT id, CASE WHEN n = 0 THEN 'no_full_span_vector_curve' ELSE concat_ws(',', {', '.join(rules)}) END AS reasons FROM t"


def _paint(s, d):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(F.lit("ok"), F.lit("pass"), F.lit("verified"), F.lit("overlay-review-required"), F.lit("suspect"), F.lit(None).cast("string")), (k % 6 + 1).cast("int"))
    allowed, why = P.paintable(status, k % 4 == 0)
    return table(s, d, "orders").select(k.alias("id"), allowed.alias("allowed"), why.alias("reason"))


def _spec_rows(s, d):
    """Six renders of a part's capacitance rows: complete, one condition a block, two voltages, another unit, three numbers, no voltage."""
    k, z = F.col("p_partkey"), F.col("p_size")
    kind, text = k % 6, lambda n: (z * n + k % 9 + 1).cast("string")
    c, o, r = text(90), text(20), text(3)
    row = lambda *cells: F.array(*[F.lit(x) if isinstance(x, str) else x for x in cells])
    full = lambda name, v, at: row("7", "capacitance", name, "-", F.concat(v, F.lit(" 9999")), "pF", f"VGS=0 V,VDS={at} V,f=1 MHz", "")
    first = F.when(kind == 0, full("Ciss", c, 40)).when(kind == 5, row("7", "Input", "Ciss", "-", c, "pF")).otherwise(full("Ciss", c, 50))
    second = F.when(kind == 0, full("Coss", o, 40)).when(kind == 2, row("8", "Output", "Coss", o, "9999", "", "VDS=25 V")).when(kind == 3, row("8", "Output", "Coss", "1.2", "nF", "")).when(kind == 4, row("8", "Output", "Coss", (z * 20).cast("string"), o, "9999")).otherwise(row("8", "Output", "Coss", o, "9999", "", ""))
    third = F.when(kind == 0, full("Crss", r, 40)).when(kind == 4, row("9", "Reverse", "Crss", "9", "5", "7")).otherwise(row("9", "Reverse", "Crss", r, "9999", "", ""))
    p = table(s, d, "part")
    far = F.when((kind == 1) & (k % 5 == 0), 20).otherwise(12)
    lines = p.select(k.alias("part"), F.explode(F.array(*[F.struct(n.alias("line"), x.alias("cells")) for n, x in ((F.lit(9), row("1", "Parameter", "Symbol")), (F.lit(10), first), (F.lit(11), second), (far, third))])).alias("x"))
    return lines.select("part", "x.line", "x.cells"), p.where(k % 2 == 1).select(k.alias("part"), (k % 80 + 1).cast("double").alias("vds"))


_ANCHORS = """WITH p AS (SELECT p_partkey AS part, p_partkey % 6 AS kind, (p_size * 90 + p_partkey % 9 + 1)::DOUBLE AS c, (p_size * 20 + p_partkey % 9 + 1)::DOUBLE AS o, (p_size * 3 + p_partkey % 9 + 1)::DOUBLE AS r, CASE WHEN p_partkey % 2 = 1 THEN (p_partkey % 80 + 1)::DOUBLE END AS fb FROM part),
 a AS (SELECT part, 'Ciss' AS name, c AS value_pf, CASE kind WHEN 0 THEN 40.0 WHEN 5 THEN fb ELSE 50.0 END::DOUBLE AS vds_v, CASE WHEN kind = 5 THEN 'block' ELSE 'row' END AS source FROM p
 UNION ALL SELECT part, 'Coss', CASE WHEN kind <> 3 THEN o END, CASE kind WHEN 0 THEN 40.0 WHEN 2 THEN 25.0 WHEN 5 THEN fb ELSE 50.0 END, CASE WHEN kind IN (0, 2) THEN 'row' ELSE 'block' END FROM p
 UNION ALL SELECT part, 'Crss', CASE WHEN kind IN (2, 4) OR (kind = 1 AND part % 5 = 0) THEN NULL ELSE r END, CASE kind WHEN 0 THEN 40.0 WHEN 5 THEN fb ELSE 50.0 END, CASE WHEN kind = 0 THEN 'row' ELSE 'block' END FROM p) SELECT * FROM a WHERE value_pf IS NOT NULL AND vds_v IS NOT NULL"""

def _captions(s, d):
    """Pages of six captions with a plot of their own above or below, by parts."""
    k = F.col("p_partkey")
    p = table(s, d, "part").select(F.floor(k / 6).alias("page"), k.alias("caption"), F.element_at(F.array(F.lit("transfer"), F.lit("body_diode"), F.lit("capacitances")), (k % 3 + 1).cast("int")).alias("family"), (k % 2 * 250.0 + 30).alias("x0"), (k % 6 * 130.0 + 100).alias("y0"), "p_size", k.alias("k"))
    captions = p.select("page", "caption", "family", "x0", "y0", (F.col("x0") + 120).alias("x1"), (F.col("y0") + 12).alias("y1"), F.lit(595.0).alias("page_width"))
    plots = p.select("page", F.col("x0").alias("px0"), (F.col("y0") + 12 + F.col("p_size") % 45).alias("py0"), (F.col("x0") + 200).alias("px1"), (F.col("y0") + 90 + F.col("p_size") % 45).alias("py1"))
    axes = p.where("k % 4 <> 0").select("page", "family", (F.col("x0") + F.col("k") % 150).alias("wx0"), (F.col("y0") + F.when(F.col("k") % 5 == 0, -90).otherwise(100)).alias("wy0"), (F.col("x0") + F.col("k") % 150 + 20).alias("wx1"), (F.col("y0") + F.when(F.col("k") % 5 == 0, -80).otherwise(110)).alias("wy1"))
    return P.caption_direction(captions, plots, axes)


_CAPTIONS = """WITH p AS (SELECT p_partkey AS k, p_partkey // 6 AS page, ['transfer', 'body_diode', 'capacitances'][CAST(p_partkey % 3 + 1 AS INT)] AS family, p_partkey % 2 * 250.0::DOUBLE + 30 AS x0, p_partkey % 6 * 130.0::DOUBLE + 100 AS y0, p_size % 45 AS z FROM part),
 c AS (SELECT *, x0 + 120 AS x1, y0 + 12 AS y1, x0 + 60 AS cx, y0 + 6 AS cy FROM p), w AS (SELECT page, family, x0 + k % 150 + 10 AS wx, x0 + k % 150 AS a, x0 + k % 150 + 20 AS b, y0 + CASE WHEN k % 5 = 0 THEN -90 ELSE 100 END AS t FROM p WHERE k % 4 <> 0),
 n AS (SELECT c.page, c.k, c.y0, c.y1, w.t + 5 AS wy, abs(w.t + 5 - cy) AS gap FROM c JOIN w ON w.page = c.page AND w.family = c.family WHERE NOT (w.a < c.x1 AND c.x0 < w.b AND w.t < c.y1 AND c.y0 < w.t + 10) AND abs(wx - cx) <= 0.22 * 595 AND abs(w.t + 5 - cy) <= CASE WHEN c.family = 'capacitances' THEN 340 ELSE 260 END),
 b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page, k ORDER BY gap, wy) = 1),
 g AS (SELECT c.k, min(CASE WHEN q.y0 + 12 + q.z >= c.y1 THEN q.y0 + 12 + q.z - c.y1 END) AS b, min(CASE WHEN q.y0 + 90 + q.z <= c.y0 THEN c.y0 - (q.y0 + 90 + q.z) END) AS a, count(CASE WHEN q.y0 + 12 + q.z >= c.y1 THEN 1 END) AS nb FROM c JOIN p q ON q.page = c.page AND q.x0 < c.x1 AND c.x0 < q.x0 + 200 GROUP BY 1)
 SELECT c.page, c.k AS caption, CASE WHEN b.wy > c.y1 THEN 'below' WHEN b.wy < c.y0 THEN 'above' END AS by_axis, coalesce(nb = 1 AND g.b <= 28 AND (g.a IS NULL OR g.b + 8 < g.a), false) AS leads_nearer, CASE WHEN g.b <= 36 AND (g.a IS NULL OR g.b + 8 < g.a) THEN 'below' WHEN g.a <= 36 THEN 'above' WHEN g.b <= 36 THEN 'below' END AS by_gap FROM c LEFT JOIN b ON b.k = c.k LEFT JOIN g ON g.k = c.k"""

def _tiers(s, d):
    """lineitem as attempts at an order's axis: the line number is the tier, every third part succeeds."""
    tier = F.element_at(F.array(F.lit("position"), F.lit("grid"), F.lit("text_order"), F.lit("ocr")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return P.axis_tiers(table(s, d, "lineitem").select(F.col("l_orderkey").alias("panel"), tier.alias("tier"), (F.col("l_partkey") % 3 == 0).alias("ok"), F.concat(F.lit("e"), (F.col("l_suppkey") % 4).cast("string")).alias("error")))


_TIERS = """WITH t AS (SELECT l_orderkey AS panel, ['position', 'grid', 'text_order', 'ocr'][CAST(l_linenumber % 4 + 1 AS INT)] AS tier, l_partkey % 3 = 0 AS ok, concat('e', l_suppkey % 4) AS error FROM lineitem),
 g AS (SELECT panel, coalesce(bool_or(ok) FILTER (tier = 'position'), false) AS p, coalesce(bool_or(ok) FILTER (tier = 'grid'), false) AS g, coalesce(bool_or(ok) FILTER (tier = 'text_order'), false) AS t, coalesce(bool_or(ok) FILTER (tier = 'ocr'), false) AS o,
 max(error) FILTER (tier = 'position' AND NOT ok) AS wp, max(error) FILTER (tier = 'grid' AND NOT ok) AS wg, max(error) FILTER (tier = 'text_order' AND NOT ok) AS wt, max(error) FILTER (tier = 'ocr' AND NOT ok) AS wo FROM t GROUP BY 1)
 SELECT panel, CASE WHEN p THEN 'position' WHEN g THEN 'grid' WHEN o THEN 'ocr' WHEN t THEN 'text_order' END AS tier, p OR g OR o AS trusted, concat_ws('; ', 'position: ' || wp, CASE WHEN NOT p THEN 'grid: ' || wg END, 'text_order: ' || wt, CASE WHEN NOT p AND NOT g THEN 'ocr: ' || wo END) AS errors FROM g"""


def _log_labels(s, d):
    """Order lines as labels of upright axes: even steps through two decades, whole decades, a log axis with peers, and peers off the line."""
    n, kind = F.col("line"), F.col("axis") % 4
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("axis"), F.col("l_linenumber").alias("line")).distinct()
    logs = F.element_at(F.array(*[F.lit(v) for v in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)]), n.cast("int"))
    odd = F.element_at(F.array(*[F.lit(v) for v in (1.0, 3.0, 4.0, 10.0, 13.0, 29.0, 37.0)]), n.cast("int"))
    value = F.when(kind == 0, 10 + 90.0 * (n - 1)).when(kind == 1, F.pow(F.lit(10.0), n - 1)).when(kind == 2, logs).otherwise(odd)
    pixel = F.when(kind == 2, F.round(400 - 100 * F.log10(logs))).otherwise(400 - 30.0 * n)
    return P.log_axis_evidence(li.select("axis", value.alias("value"), pixel.alias("pixel")))


_LOGS = """WITH li AS (SELECT DISTINCT l_orderkey AS axis, l_linenumber AS n FROM lineitem), l AS (SELECT axis, CASE axis % 4 WHEN 0 THEN 10 + 90.0 * (n - 1) WHEN 1 THEN pow(10.0, n - 1) WHEN 2 THEN [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0][CAST(n AS INT)] ELSE [1.0, 3.0, 4.0, 10.0, 13.0, 29.0, 37.0][CAST(n AS INT)] END::DOUBLE AS value, CASE WHEN axis % 4 = 2 THEN round(400 - 100 * log10([1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0][CAST(n AS INT)]::DOUBLE)) ELSE 400 - 30.0 * n END::DOUBLE AS pixel FROM li),
 t AS (SELECT *, value - lag(value) OVER w AS dv, pixel - lag(pixel) OVER w AS dp, CASE WHEN abs(pow(10.0, round(log10(value))) / value - 1) < 1e-9 THEN round(log10(value)) END AS k FROM l WINDOW w AS (PARTITION BY axis ORDER BY value, pixel DESC)),
 g AS (SELECT axis, count(*) AS n, count(DISTINCT value) AS d, min(value) AS lo, median(dv) AS st, max(dv) AS wd, min(dv) AS nr, max(dp) AS up, sqrt(greatest(regr_syy(value, pixel) - regr_sxy(value, pixel) * regr_sxy(value, pixel) / nullif(regr_sxx(value, pixel), 0), 0) / count(*)) AS off, count(k) AS dec, regr_slope(k, pixel) AS m, regr_intercept(k, pixel) AS b, max(pixel) FILTER (k IS NOT NULL) - min(pixel) FILTER (k IS NOT NULL) AS sp FROM t GROUP BY 1),
 q AS (SELECT t.axis, bool_and(coalesce(abs((log10(value) - b) / nullif(m, 0) - pixel) <= greatest(1.5, 0.02 * sp), false)) AS ok FROM t JOIN g USING (axis) WHERE k IS NULL AND value > 0 AND NOT EXISTS (SELECT 1 FROM t u WHERE u.axis = t.axis AND u.k IS NOT NULL AND u.pixel = t.pixel) GROUP BY 1),
 r AS (SELECT *, coalesce(n >= 4 AND d = n AND lo >= 0 AND st > 0 AND greatest(wd - st, st - nr) <= greatest(1e-9, 0.05 * st) AND up < 0 AND off <= greatest(1e-6, 0.03 * st), false) AS ladder FROM g)
 SELECT r.axis, dec AS n_decades, ladder, dec >= 2 AND ladder AND n > dec AS contradicted, CASE WHEN dec < 2 THEN true WHEN NOT coalesce(sp > 0, false) THEN false ELSE coalesce(q.ok, true) END AS corroborated FROM r LEFT JOIN q USING (axis)"""

def _closure(s, d):
    """Records of two curves by parts, each with the faults that its number's remainders say."""
    k = F.col("p_partkey")
    bad = lambda m: k % m == 1
    p = table(s, d, "part").select(k.alias("entity"), "p_partkey")
    one = lambda v, fault, m: F.when(bad(m), F.lit(fault)).otherwise(F.lit(v))
    rec = p.select("entity", F.lit(2).alias("expected_curves"), (~bad(5)).alias("artifacts"), F.lit(800).alias("source_w"), F.lit(600).alias("source_h"), F.lit(800).alias("overlay_w"), one(660, 640, 7).alias("overlay_h"), one("x  axis y axis digitized Vgs Id", "x axis", 11).alias("overlay_text"), F.lit("Vgs").alias("x_quantity"), F.lit("V").alias("x_unit"), F.lit("linear").alias("x_scale"), F.lit(0.0).alias("x_min"), F.lit(10.0).alias("x_max"), F.lit("Id").alias("y_quantity"), one("A", "mA", 13).alias("y_unit"), F.lit("linear").alias("y_scale"), F.lit(0.0).alias("y_min"), F.lit(100.0).alias("y_max"), F.lit(50.0).alias("px0"), F.lit(40.0).alias("py0"), one(750.0, 850.0, 17).alias("px1"), F.lit(560.0).alias("py1"), F.array(F.lit(25.0), F.lit(125.0)).alias("labels"), F.lit(0.05).alias("allowed_gap"), (~bad(19)).alias("provenance"), F.lit(False).alias("vector"), one(0.02, 0.3, 23).alias("collapse"))
    pts = p.withColumn("curve", F.explode(F.when(bad(29), F.array(F.lit(1).cast("long"))).otherwise(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(24))))
    shift = F.when(bad(31), 0.0).otherwise((F.col("curve") - 1) * 0.5)
    vgs = 2 + F.col("i") * 0.2 + shift - F.when(bad(37) & (F.col("i") == 10), 1.0).otherwise(0.0)
    pts = pts.select("entity", "curve", "i", F.when(bad(41), 25.0).otherwise((F.col("curve") - 1) * 100.0 + 25).alias("temperature"), vgs.alias("vgs"), (F.col("i") * 4.0).alias("id"))
    both = p.withColumn("curve", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    ident = both.select("entity", "curve", ((F.col("curve") - 1) * 100.0 + 25).alias("temperature"))
    diag = both.select("entity", "curve", F.lit(25).alias("points"), F.lit(0.9).alias("y_span"), one(0.02, 0.2, 43).alias("max_gap"), F.lit(0.0).alias("violation"))
    return G.verdicts(K.closure_gates(rec, pts, ident, diag))


def _closure_sql() -> str:
    bad = lambda m: f"p_partkey % {m} = 1"
    faults = [bad(5), bad(7), bad(11), bad(13), bad(17), bad(29), f"({bad(29)} OR {bad(41)})", f"({bad(13)} OR {bad(17)})", f"({bad(13)} OR {bad(17)} OR {bad(37)})", f"({bad(29)} OR {bad(43)})", bad(19), f"({bad(23)} OR ({bad(31)} AND NOT {bad(29)}))"]
    names = ", ".join(f"CASE WHEN {f} THEN '{g}' END" for g, f in zip(K.GATES, faults, strict=True))
    count = " + ".join(f"({f})::INT" for f in faults)
    return f"WITH t AS (SELECT p_partkey AS entity, {count} AS bad, concat_ws(',', {names}) AS reasons FROM part) SELECT entity, CAST(12 AS BIGINT) AS n_gates, CAST(12 - bad AS BIGINT) AS n_passed, CASE WHEN bad = 0 THEN 'accepted' ELSE 'rejected' END AS status, reasons FROM t"


def _waveforms(s, d):
    """Parts as captions of pages of five: waveforms, circuits and others, some with numbers in their panel or a page that names the circuit."""
    k = F.col("p_partkey")
    titles = F.array(*[F.lit(t) for t in ("Gate-charge waveform", "Gate charge test circuit", "Output characteristics", "Gate charge waveforms", "Transfer")])
    p = table(s, d, "part").select(F.floor(k / 5).alias("page"), (k % 25 + 8).alias("number"), F.element_at(titles, (k % 5 + 1).cast("int")).alias("title"), F.when(k % 7 == 0, "(10); 2.5 V 3").otherwise("VGS Qg 5").alias("text"), k.alias("k"))
    pages = p.where("k % 5 = 3 AND k % 3 = 0").select("page", F.concat(F.lit("Figure "), (F.col("number") - 1).cast("string"), F.lit(". Gate-charge measurement circuit")).alias("text"))
    return P.waveform_definitions(p.drop("k"), pages)


_WAVEFORMS = """WITH p AS (SELECT p_partkey AS k, p_partkey // 5 AS page, p_partkey % 25 + 8 AS number FROM part) SELECT page, number, CASE k % 5 WHEN 0 THEN k % 7 <> 0 AND (number + 1) // 10 = number // 10 WHEN 3 THEN k % 7 <> 0 AND k % 3 = 0 ELSE false END AS definition FROM p"""

QUERIES = {
    "text_waveform_definitions": (_waveforms, _WAVEFORMS),
    "axis_merged_ticks": (lambda s, d: P.merged_ticks(table(s, d, "lineitem").select(F.col("l_orderkey").alias("axis"), F.col("l_quantity").alias("value"), (F.col("l_partkey") % 40 * 1.0).alias("pixel"))), "WITH l AS (SELECT l_orderkey AS axis, l_quantity AS value, (l_partkey % 40)::DOUBLE AS pixel FROM lineitem), n AS (SELECT *, CASE WHEN pixel - lag(pixel) OVER w > 3 THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY axis ORDER BY pixel, value)), g AS (SELECT *, sum(new) OVER (PARTITION BY axis ORDER BY pixel, value ROWS UNBOUNDED PRECEDING) AS r FROM n) SELECT axis, median(value) AS value, median(pixel) AS pixel, count(*) AS n FROM g GROUP BY axis, r"),
    "closure_audit": (_closure, _closure_sql()),
    "axis_tiers": (_tiers, _TIERS),
    "axis_log_evidence": (_log_labels, _LOGS),
    "panel_caption_direction": (_captions, _CAPTIONS),
    "anchor_capacitances": (lambda s, d: A.capacitance_anchors(*_spec_rows(s, d)), _ANCHORS),
    "panel_exported": (_exported, f"WITH {CLEAN} SELECT curve, round(x, 4) AS x, round((floor(x) - 20) / 719.0, 6) AS x_norm, round((510 - round(y)) / 499.0, 6) AS y_norm FROM cl"),
    "panel_cubics": (_cubics, _CUBICS),
    "panel_strokes": (_strokes, _STROKES),
    "panel_pixel_columns": (_pixels, _PIXELS),
    "panel_trace_checks": (_checks, _CHECKS),
    "panel_pairwise_collapse": (_collapse, _COLLAPSE),
    "panel_temperatures": (_families, _FAMILIES),
    "panel_table_rows": (_rows_of_tables, _ROWS),
    "panel_paintable": (_paint, "WITH t AS (SELECT o_orderkey AS id, ['ok', 'pass', 'verified', 'overlay-review-required', 'suspect', NULL][CAST(o_orderkey % 6 + 1 AS INT)] AS st, o_orderkey % 4 = 0 AS rv FROM orders) SELECT id, coalesce(st IN ('ok', 'pass', 'verified') OR (rv AND st = 'overlay-review-required'), false) AS allowed, CASE WHEN st IN ('ok', 'pass', 'verified') THEN 'accepted_status' WHEN rv AND st = 'overlay-review-required' THEN 'explicit_review_overlay' ELSE concat('status_not_embeddable:', coalesce(st, '')) END AS reason FROM t"),
    "panel_families": (lambda s, d: P.union_families({"supplier": table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), "part": table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))}), "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::INT AS size, 'supplier' AS family FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, p_size, 'part' FROM part"),
    "panel_first_paths": (lambda s, d: P.first_paths(table(s, d, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path")), 25), "SELECT concat_ws('/', p_brand, p_type, p_partkey) AS path FROM part ORDER BY path LIMIT 25"),
    "panel_ocr_words": (_tsv, _TSV),
    "panel_strict_json": (_json, "SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN event_id WHEN 2 THEN NULL ELSE CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS k FROM events"),
    "axis_tick_evidence": (lambda s, d: _round(P.tick_evidence(_gate_ticks(s, d)), quality_fit=6).withColumn("quality_fit", F.col("quality_fit") + 0.0), _EVIDENCE),
    "axis_own_column": (lambda s, d: P.own_axis(table(s, d, "lineitem").select(F.col("l_orderkey").alias("panel"), F.col("l_partkey").alias("column"), (F.col("l_quantity") % 5).alias("gap"), (F.col("l_suppkey") % 6).alias("n"))), "SELECT l_orderkey AS panel, l_partkey AS \"column\", l_quantity % 5 AS gap, l_suppkey % 6 AS n FROM lineitem WHERE l_suppkey % 6 >= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity % 5, l_suppkey % 6 DESC, l_partkey) = 1"),
    "axis_beyond_ticks": (lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("axis")).agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")).select("axis", P.beyond_ticks((F.col("axis") % 60).cast("double"), F.col("lo"), F.col("hi"), F.col("n")).alias("beyond")), "SELECT l_orderkey AS axis, count(*) >= 2 AND max(l_quantity) > min(l_quantity) AND NOT l_orderkey % 60 BETWEEN min(l_quantity) - 0.1 * (max(l_quantity) - min(l_quantity)) AND max(l_quantity) + 0.1 * (max(l_quantity) - min(l_quantity)) AS beyond FROM lineitem GROUP BY 1"),
    **{f"valid_resistance_{k}": (lambda s, d, k=k: _resistance(s, d, k), _resistance_sql(k)) for k in ("normalized", "absolute", "current")},
}
