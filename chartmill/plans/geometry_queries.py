"""Queries of strokes, frames, words, tracking and order over lineitem, part, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import axis as A
from ..operators import geometry as G
from ..session import table
from . import stepwise_sql
from .adapters import TICKS
from .axis_queries import _GRID, _SHAPED, _grid, _shaped
from .curve_queries import _clean, _round


def _strokes(s, d):
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("panel"), F.col("l_linenumber").cast("long").alias("id")).agg(F.min("l_quantity").alias("q"))
    return li.select("panel", "id", (F.col("id") * 10.0).alias("x0"), (F.col("q") % 4).alias("y0"), (F.col("id") * 10.0 + 10).alias("x1"), ((F.col("q") * 3) % 4).alias("y1"))


_STROKES = "sk AS (SELECT panel, id, CAST(id * 10 AS DOUBLE) AS x0, q % 4 AS y0, CAST(id * 10 + 10 AS DOUBLE) AS x1, (q * 3) % 4 AS y1 FROM (SELECT l_orderkey AS panel, CAST(l_linenumber AS BIGINT) AS id, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2))"


def _words(s, d):
    """Pages of 30 words, six on a row, with gaps of -3 to 5 points."""
    k = F.col("p_partkey")
    x0, cy = (k % 6) * 50.0, F.floor(k % 30 / 6) * 14.0 + k * 11 % 3
    return table(s, d, "part").select(F.floor(k / 30).alias("page"), k.alias("id"), F.col("p_name").alias("text"), x0.alias("x0"), (x0 + 45 + F.col("p_size") % 9).alias("x1"), cy.alias("cy"))


_WORDS = "w AS (SELECT p_partkey // 30 AS page, p_partkey AS id, p_name AS text, p_partkey % 6 * 50.0::DOUBLE AS x0, p_partkey % 6 * 50.0::DOUBLE + 45 + p_size % 9 AS x1, p_partkey % 30 // 6 * 14.0::DOUBLE + p_partkey * 11 % 3 AS cy FROM part)"


def _rules(s, d):
    """A page of part rows: every third page is a clean grid, the rest are stray rules."""
    k = F.explode(F.sequence(F.lit(0), F.lit(5)))
    p = table(s, d, "part").select(F.col("p_partkey").alias("page"), "p_size", k.alias("k"))
    jig = F.when(F.col("page") % 3 == 0, 0.0).otherwise((F.col("k") * F.col("p_size") % 7) * 4.0)
    flat = p.select("page", (50.0 + jig).alias("x0"), (100.0 + F.col("k") * 20).alias("y0"), (250.0 + jig).alias("x1"), (100.0 + F.col("k") * 20).alias("y1"))
    tall = p.select("page", (50.0 + F.col("k") * 40).alias("x0"), F.lit(100.0).alias("y0"), (50.0 + F.col("k") * 40).alias("x1"), F.lit(200.0).alias("y1"))
    return flat.unionByName(tall)


_RULES = "pk AS (SELECT p_partkey AS page, p_size, k, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE (k * p_size % 7) * 4 END AS jig FROM part CROSS JOIN (SELECT unnest(range(0, 6)) AS k))"


def _tail(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    num = lambda m, scale: (k * m % 97) / F.lit(97.0) * scale
    return o.select(k.alias("id"), G.vendor_tail(num(5, 60.0), F.when(k % 7 != 0, num(11, 60.0)), num(13, 40.0), F.when(k % 5 != 0, num(17, 200.0) + 50), (F.lit(5.0), F.lit(50.0)), num(19, 200.0), F.when(k % 3 == 0, num(23, 200.0) + 50)).alias("status"))


def _n(m, scale):
    return f"(o_orderkey * {m} % 97) / 97.0::DOUBLE * {scale}"


def _exports(s, d):
    p = table(s, d, "part")
    t = F.explode(F.array(F.lit("Ciss"), F.lit("Coss"), F.lit("Crss")))
    r = p.select(F.col("p_partkey").alias("panel"), t.alias("trace"), "p_size")
    return r.select("panel", "trace", F.when(F.col("panel") % 9 != 0, F.col("p_size") - 1).alias("n"), F.when((F.col("panel") % 4 == 0) & (F.col("trace") == "Coss"), F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.when(F.col("panel") % 5 != 0, F.col("p_size").cast("double")).alias("anchor_pf"), (F.col("panel") % 40).cast("double").alias("sampled_pf"))


QUERIES = {
    "geo_line_frames": (lambda s, d: G.line_frames(_rules(s, d)), f"WITH {_RULES}, r AS (SELECT page, round(50 + jig)::DOUBLE AS x0, round(250 + jig)::DOUBLE AS x1, count(*) AS n_rows, min(100 + k * 20) AS top, max(100 + k * 20) AS bottom FROM pk GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT page, x0, 100.0::DOUBLE AS y0, x1, 200.0::DOUBLE AS y1, n_rows, 6 AS n_cols FROM r WHERE abs(x0 - 50) <= 1.5 AND abs(x1 - 250) <= 1.5 AND abs(top - 100) <= 1.5 AND abs(bottom - 200) <= 1.5"),
    "geo_stroke_joins": (lambda s, d: _round(G.stroke_joins(_strokes(s, d), 1.5)), f"WITH {_STROKES}, p AS (SELECT a.panel, a.id AS tail, b.id AS head, sqrt((a.x1 - b.x0) * (a.x1 - b.x0) + (a.y1 - b.y0) * (a.y1 - b.y0)) AS distance FROM sk a JOIN sk b ON a.panel = b.panel AND a.id <> b.id), q AS (SELECT *, count(*) OVER (PARTITION BY panel, tail) AS nt, count(*) OVER (PARTITION BY panel, head) AS nh FROM p WHERE distance <= 1.5) SELECT panel, tail, head, round(distance, 4) AS distance FROM q WHERE nt = 1 AND nh = 1"),
    "geo_connected_strokes": (lambda s, d: G.connected_strokes(_strokes(s, d)), stepwise_sql.CONNECTED.format(strokes=_STROKES)),
    "geo_side_by_side": (lambda s, d: G.side_by_side(_words(s, d)), f"WITH {_WORDS}, p AS (SELECT a.page, a.id AS l, b.id AS r, concat(a.text, b.text) AS text FROM w a JOIN w b ON a.page = b.page AND a.id <> b.id WHERE b.x0 - a.x1 BETWEEN -0.75 AND 5 AND abs(a.cy - b.cy) <= 2) SELECT page, l AS \"left\", r AS \"right\", text FROM p QUALIFY count(*) OVER (PARTITION BY page, l) = 1 AND count(*) OVER (PARTITION BY page, r) = 1"),
    "geo_track": (lambda s, d: _round(G.track(_clean(s, d).select(F.col("curve").alias("panel"), F.round("x").alias("x"), "y"), 60.0, 20)), stepwise_sql.TRACK),
    "geo_trusted_subset": (lambda s, d: G.trusted_subset(_shaped(s, d)), stepwise_sql.TRUSTED_SUBSET.format(shaped=f"{TICKS}, src AS ({_SHAPED})")),
    "geo_grid_regions": (lambda s, d: G.grid_regions(_rules(s, d).where("y0 = y1").select("page", F.col("y0").cast("long").alias("id"), "x0", "x1", F.col("y0").alias("y"))), stepwise_sql.GRID_REGIONS.format(rules=_RULES)),
    "geo_same_curve": (lambda s, d: _round(G.same_curve(_clean(s, d).groupBy("curve", F.floor(F.col("x") / 24).cast("double").alias("x")).agg(F.round(F.avg("y"), 6).alias("y")), _clean(s, d).select(F.col("curve").alias("left"), (F.col("curve") + 1).alias("right")).distinct())), "WITH pts AS (SELECT user_id AS curve, round(greatest((epoch_us(ts) - 1704067200000000) / 3600000000.0, 0), 10) AS x, median(value) AS y FROM events WHERE value > 0 GROUP BY 1, 2), b AS (SELECT curve, floor(x / 24) AS x, round(avg(y), 6) AS y FROM pts GROUP BY 1, 2), p AS (SELECT DISTINCT curve AS l, curve + 1 AS r FROM pts), a AS (SELECT l, r, x, y FROM p JOIN b ON curve = l), c AS (SELECT l, r, x, y FROM p JOIN b ON curve = r), j AS (SELECT l, r, abs(a.y - c.y) AS dd FROM a FULL JOIN c USING (l, r, x)), g AS (SELECT l, r, count(dd) / count(*) AS share, avg(dd) AS md, list_sort(list(dd) FILTER (dd IS NOT NULL)) AS al FROM j GROUP BY 1, 2) SELECT l AS \"left\", r AS \"right\", round(share, 4) AS share, round(md, 4) AS mean_difference, round(al[least(len(al), CAST(floor(0.95 * len(al)) AS INT) + 1)], 4) AS p95, coalesce(share >= 0.9 AND md <= 1 AND al[least(len(al), CAST(floor(0.95 * len(al)) AS INT) + 1)] <= 2, false) AS same FROM g"),
    "geo_exchange": (lambda s, d: G.exchanged_below(table(s, d, "lineitem").select(F.col("l_orderkey").alias("curve"), F.col("l_returnflag").alias("trace"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y")), F.lit(20.0), "A", "R").groupBy("curve", "trace").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("y")), "SELECT l_orderkey AS curve, CASE WHEN l_quantity < 20 AND l_returnflag = 'A' THEN 'R' WHEN l_quantity < 20 AND l_returnflag = 'R' THEN 'A' ELSE l_returnflag END AS trace, count(*) AS n, round(sum(l_tax), 4) AS y FROM lineitem GROUP BY 1, 2"),
    "axis_tick_columns": (lambda s, d: A.tick_columns(_words(s, d).select("page", "id", "x0").withColumnRenamed("x0", "x"), 12.0), f"WITH {_WORDS.replace('p_partkey % 6 * 50.0::DOUBLE AS x0', 'p_partkey % 6 * 50.0::DOUBLE AS x')}, n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, id) > 12 THEN 1 ELSE 0 END AS new FROM w) SELECT page, id, x, CAST(sum(new) OVER (PARTITION BY page ORDER BY x, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS \"column\" FROM n"),
    "valid_vendor_tail": (_tail, f"WITH t AS (SELECT o_orderkey AS id, {_n(5, 60.0)} AS fv, CASE WHEN o_orderkey % 7 <> 0 THEN {_n(11, 60.0)} END AS vi, {_n(13, 40.0)} AS tl, CASE WHEN o_orderkey % 5 <> 0 THEN {_n(17, 200.0)} + 50 END AS tot, {_n(19, 200.0)} AS ch, CASE WHEN o_orderkey % 3 = 0 THEN {_n(23, 200.0)} + 50 END AS ref FROM orders) SELECT id, CASE WHEN vi IS NULL OR tot IS NULL THEN NULL WHEN NOT (fv BETWEEN 5 AND 50 AND vi BETWEEN 5 AND 50) THEN 'out_of_range' WHEN abs(ch + tl - coalesce(ref, tot)) / coalesce(ref, tot) <= 0.25 THEN 'pass' ELSE 'fail' END AS status FROM t"),
    "valid_export_verdicts": (lambda s, d: G.export_verdicts(_exports(s, d)), "WITH t AS (SELECT p_partkey AS panel, trace, CASE WHEN p_partkey % 9 <> 0 THEN p_size - 1 END AS n, p_partkey % 4 = 0 AND trace = 'Coss' AS bad, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS a, CAST(p_partkey % 40 AS DOUBLE) AS sm FROM part CROSS JOIN (SELECT unnest(['Ciss', 'Coss', 'Crss']) AS trace)), v AS (SELECT *, coalesce(abs(a - sm) / nullif(a, 0) > 0.25, false) AS far, coalesce(trace = 'Crss' AND a <= 15, false) AS tiny FROM t), w AS (SELECT *, CASE WHEN coalesce(n, 0) = 0 THEN 'absent' WHEN bad THEN 'rejected' WHEN far AND NOT tiny THEN 'rejected' ELSE 'pass' END AS status FROM v) SELECT panel, trace, status, CASE WHEN status = 'pass' AND tiny AND far THEN a - sm ELSE 0.0 END AS offset_pf FROM w"),
    "valid_two_curve_order": (lambda s, d: G.two_curve_order(_grid(s, d), 20.0), _GRID + ", sg AS (SELECT pair, i, CASE WHEN right_value - left_value > 20 THEN 1 WHEN right_value - left_value < -20 THEN -1 ELSE 0 END AS sign FROM grid), ch AS (SELECT *, CASE WHEN sign <> coalesce(lag(sign) OVER (PARTITION BY pair ORDER BY i), 99) THEN 1 ELSE 0 END AS new FROM sg), rn AS (SELECT *, sum(new) OVER (PARTITION BY pair ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM ch), ag AS (SELECT pair, run, sign FROM rn GROUP BY 1, 2, 3 HAVING sign <> 0 AND count(*) >= 5), mg AS (SELECT * FROM ag QUALIFY sign <> coalesce(lag(sign) OVER (PARTITION BY pair ORDER BY run), 0)), sq AS (SELECT p.pair, coalesce(string_agg(CAST(sign AS VARCHAR), ',' ORDER BY run), '') AS signs FROM (SELECT DISTINCT pair FROM grid) p LEFT JOIN mg ON mg.pair = p.pair GROUP BY 1) SELECT pair, signs, CASE WHEN signs NOT IN ('-1', '-1,1', '1') THEN 'contradictory' WHEN signs = '-1' THEN 'ordered' ELSE 'crossover' END AS status FROM sq"),
}

