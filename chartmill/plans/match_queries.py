"""Queries of joins and aggregates over parts, lineitem, orders, events, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as G
from ..operators import match as M
from ..session import table
from . import stepwise_sql
from .adapters import BOXES, POINTS, box_table, event_points
from .curve_queries import CLEAN, _clean, _round

_IX = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AR = "(a.x1 - a.x0) * (a.y1 - a.y0)"
_BR = "(b.x1 - b.x0) * (b.y1 - b.y0)"


def _words(s, d):
    p = table(s, d, "part")
    return p.select(F.floor(F.col("p_partkey") / 50).alias("page"), F.col("p_partkey").alias("word"), ((F.col("p_partkey") * 71) % 560).cast("double").alias("cx"), ((F.col("p_partkey") * 29) % 760).cast("double").alias("cy"))


def _tokens(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_type").alias("key"), F.col("p_partkey").alias("id"), F.array_union(F.split("p_name", " "), F.array(F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("b"), F.substring("p_brand", 7, 1)))).alias("tokens"))


_TOK = "tok AS (SELECT p_type AS key, p_partkey AS id, list_distinct(list_concat(string_split(p_name, ' '), ['s' || (p_size % 5), 'b' || substr(p_brand, 7, 1)])) AS tokens FROM part)"
_SIM = "len(list_intersect(a.tokens, b.tokens)) / CAST(len(list_distinct(list_concat(a.tokens, b.tokens))) AS DOUBLE)"


def _law(s, d):
    """Transfer points: V from quantity, I = 0.8 (V - 3)^2 scaled by discount noise, by supplier."""
    li = table(s, d, "lineitem")
    v = F.col("l_quantity") / 5 + 3.2
    return li.select(F.col("l_suppkey").alias("curve"), v.alias("v"), (0.8 * (v - 3) * (v - 3) * (1 + (F.col("l_discount") - 0.05) / 10)).alias("i"))


_LAW_SQL = "p AS (SELECT l_suppkey AS curve, l_quantity / 5 + 3.2 AS v, l_discount AS dc FROM lineitem), q AS (SELECT curve, v, 0.8 * (v - 3) * (v - 3) * (1 + (dc - 0.05) / 10) AS i FROM p)"


def _pivots(s, d):
    """Pivots on the law but for every seventh supplier, and for every eleventh beyond the curve."""
    k = F.col("s_suppkey")
    i = F.when(k % 11 == 0, 4000.0).otherwise(10.0 + k % 40)
    return table(s, d, "supplier").select(k.alias("curve"), (3 + F.sqrt(i / 0.8) + F.when(k % 7 == 0, 0.4).otherwise(0.0)).alias("vpl"), i.alias("id_pl"))


_PIVOTS_SQL = "pv AS (SELECT curve, 3 + sqrt(id_pl / 0.8) + CASE WHEN curve % 7 = 0 THEN 0.4 ELSE 0 END AS vpl, id_pl FROM (SELECT s_suppkey AS curve, CASE WHEN s_suppkey % 11 = 0 THEN 4000.0 ELSE 10.0 + s_suppkey % 40 END::DOUBLE AS id_pl FROM supplier))"


def _gates(s, d):
    o = table(s, d, "orders")
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    g = o.select(F.col("o_orderkey").alias("entity"), k.alias("seq"), "o_totalprice", "o_orderstatus")
    passed = F.when(F.col("seq") == 1, F.col("o_totalprice") > 50000).when(F.col("seq") == 2, F.when(F.col("entity") % 11 != 0, F.col("o_orderstatus") != "P")).otherwise(F.lit(True))
    return g.select("entity", "seq", F.concat(F.lit("gate"), F.col("seq").cast("string")).alias("gate"), passed.alias("passed"), F.when(~passed, F.concat(F.lit("failed_"), F.col("seq").cast("string"))).alias("reason"))


QUERIES = {
    "join_words_in_box": (lambda s, d: M.contained(_words(s, d), box_table(s, d).withColumnRenamed("id", "panel")), f"WITH {BOXES}, w AS (SELECT p_partkey // 50 AS page, p_partkey AS word, CAST((p_partkey * 71) % 560 AS DOUBLE) AS cx, CAST((p_partkey * 29) % 760 AS DOUBLE) AS cy FROM part) SELECT page, id AS panel, word FROM w JOIN boxes USING (page) WHERE cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1"),
    "join_box_overlap": (lambda s, d: _round(M.overlapping_pairs(box_table(s, d), 0.05), iou=6, of_smaller=6), f"WITH {BOXES}, p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, {_IX} / ({_AR} + {_BR} - {_IX}) AS iou, {_IX} / least({_AR}, {_BR}) AS of_smaller FROM boxes a JOIN boxes b ON a.page = b.page AND a.id < b.id) SELECT page, a_id, b_id, round(iou, 6) AS iou, round(of_smaller, 6) AS of_smaller FROM p WHERE iou >= 0.05"),
    "join_box_suppression": (lambda s, d: M.suppress(box_table(s, d).withColumn("seq", F.col("id")), 0.2), stepwise_sql.SUPPRESSION),
    "join_nearest": (lambda s, d: _round(M.nearest(_words(s, d).select("page", F.col("word").alias("lid"), "cx", "cy"), box_table(s, d).select("page", F.col("id").alias("rid"), "x0", "y0"), "page", F.sqrt((F.col("cx") - F.col("x0")) ** 2 + (F.col("cy") - F.col("y0")) ** 2), 90.0), distance=6), f"WITH {BOXES}, w AS (SELECT p_partkey // 50 AS page, p_partkey AS lid, CAST((p_partkey * 71) % 560 AS DOUBLE) AS cx, CAST((p_partkey * 29) % 760 AS DOUBLE) AS cy FROM part), j AS (SELECT page, lid, id AS rid, sqrt((cx - x0) * (cx - x0) + (cy - y0) * (cy - y0)) AS distance FROM w JOIN boxes USING (page)) SELECT page, lid, rid, round(distance, 6) AS distance FROM j WHERE distance <= 90 QUALIFY row_number() OVER (PARTITION BY page, lid ORDER BY round(distance, 9), rid) = 1"),
    "join_mutual_nearest": (lambda s, d: _round(M.mutual_nearest(_words(s, d).select(F.col("page").alias("grp"), F.col("word").alias("lid"), "cx").join(box_table(s, d).select(F.col("page").alias("grp"), F.col("id").alias("rid"), "x0"), "grp").select("grp", "lid", "rid", F.abs(F.col("cx") - F.col("x0")).alias("distance")), 0.0)), f"WITH {BOXES}, w AS (SELECT p_partkey // 50 AS grp, p_partkey AS lid, CAST((p_partkey * 71) % 560 AS DOUBLE) AS cx FROM part), j AS (SELECT grp, lid, id AS rid, abs(cx - x0) AS distance FROM w JOIN boxes ON page = grp), r AS (SELECT *, row_number() OVER l AS rl, row_number() OVER r AS rr, lead(distance) OVER l AS nl, lead(distance) OVER r AS nr FROM j WINDOW l AS (PARTITION BY grp, lid ORDER BY distance, rid), r AS (PARTITION BY grp, rid ORDER BY distance, lid)) SELECT grp, lid, rid, round(distance, 4) AS distance FROM r WHERE rl = 1 AND rr = 1 AND coalesce(nl - distance >= 0, true) AND coalesce(nr - distance >= 0, true)"),
    "join_greedy_match": (lambda s, d: M.greedy_match(_words(s, d).select(F.col("page").alias("grp"), F.col("word").alias("lid"), "cx").join(box_table(s, d).select(F.col("page").alias("grp"), F.col("id").alias("rid"), "x0"), "grp").select("grp", "lid", "rid", F.abs(F.col("cx") - F.col("x0")).alias("distance")), 60.0), stepwise_sql.GREEDY),
    "join_similar_sets": (lambda s, d: _round(M.similar_pairs(_tokens(s, d), "key", 0.6)), f"WITH {_TOK} SELECT a.key, a.id AS a, b.id AS b, round({_SIM}, 4) AS similarity FROM tok a JOIN tok b ON a.key = b.key AND a.id < b.id WHERE {_SIM} >= 0.6"),
    "join_rounded_key": (lambda s, d: M.matched_on_rounded(event_points(s, d).where("trace = 'click'"), event_points(s, d).where("trace = 'view'"), -1), f"WITH {POINTS}, l AS (SELECT curve, round(x, -1) AS rx, y AS left_y FROM pts WHERE trace = 'click' QUALIFY row_number() OVER (PARTITION BY curve, rx ORDER BY seq DESC) = 1), r AS (SELECT curve, round(x, -1) AS rx, y AS right_y FROM pts WHERE trace = 'view' QUALIFY row_number() OVER (PARTITION BY curve, rx ORDER BY seq DESC) = 1) SELECT curve, rx, left_y, right_y FROM l JOIN r USING (curve, rx)"),
    "join_cross_panel": (lambda s, d: _round(M.cross_panel(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), (F.col("l_linenumber") % 3).cast("bigint").alias("panel")).agg(F.max("l_linenumber").alias("axis"), (F.max("l_quantity") % 3).alias("fixed")), table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("doc"), (F.col("l_linenumber") % 3).cast("bigint").alias("panel"), (F.col("l_quantity") % 3).alias("at")).agg(F.avg("l_tax").alias("value"))), a_value=6, b_value=6), "WITH p AS (SELECT l_suppkey AS doc, l_linenumber % 3 AS panel, max(l_linenumber) AS axis, max(l_quantity) % 3 AS fixed FROM lineitem GROUP BY 1, 2), v AS (SELECT l_suppkey AS doc, l_linenumber % 3 AS panel, l_quantity % 3 AS pos, avg(l_tax) AS value FROM lineitem GROUP BY 1, 2, 3) SELECT a.doc, CAST(a.panel AS BIGINT) AS a_panel, CAST(b.panel AS BIGINT) AS b_panel, round(x.value, 6) AS a_value, round(y.value, 6) AS b_value, round(x.value / nullif(y.value, 0) - 1, 4) AS err FROM p a JOIN p b ON a.doc = b.doc AND a.axis < b.axis JOIN v x ON x.doc = a.doc AND x.panel = a.panel AND x.pos = b.fixed JOIN v y ON y.doc = a.doc AND y.panel = b.panel AND y.pos = a.fixed"),
    "join_left_anchors": (lambda s, d: table(s, d, "part").join(table(s, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("anchor")), "p_partkey", "left").select("p_partkey", "anchor", F.when(F.col("anchor").isNull(), "anchor_missing").otherwise("ok").alias("status")), "SELECT p_partkey, anchor, CASE WHEN anchor IS NULL THEN 'anchor_missing' ELSE 'ok' END AS status FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS anchor FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_partkey = p_partkey"),
    "join_semi_anti": (lambda s, d: table(s, d, "part").join(table(s, d, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey", F.lit("unserved").alias("side")).unionByName(table(s, d, "supplier").join(table(s, d, "lineitem").where("l_tax = 0").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi").select(F.col("s_suppkey").alias("p_partkey"), F.lit("served").alias("side"))), "SELECT p_partkey, 'unserved' AS side FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09) UNION ALL SELECT s_suppkey, 'served' FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_tax = 0)"),
    "agg_best_row": (lambda s, d: G.best_row(table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_discount"), ["l_partkey"], F.desc("l_discount"), F.asc("l_orderkey"), F.asc("l_linenumber")), "SELECT l_partkey, l_orderkey, l_linenumber, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) = 1"),
    "agg_last_wins": (lambda s, d: G.best_row(table(s, d, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], F.desc("turn")), "SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY 1, 2"),
    "agg_exactly_one": (lambda s, d: G.exactly_one(table(s, d, "lineitem").select("l_orderkey", (F.col("l_quantity") - 25).alias("q")), "l_orderkey", "q"), "SELECT l_orderkey, CASE WHEN count(DISTINCT l_quantity) = 1 AND min(l_quantity) > 25 THEN min(l_quantity) - 25 END AS value, CASE WHEN count(DISTINCT l_quantity) > 1 THEN 'conflicting' WHEN min(l_quantity) <= 25 THEN 'not_positive' END AS reason FROM lineitem GROUP BY 1"),
    "agg_inherit_blocks": (lambda s, d: G.inherit_in_blocks(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("part"), F.col("l_linenumber").alias("line")).agg(F.min("l_returnflag").alias("rf"), F.min("l_quantity").alias("q")).where("q > 12").select("part", "line", F.when(F.col("rf") != "N", F.col("rf")).alias("unit"), F.when(F.col("q") > 30, F.col("q") % 2).alias("condition")), 1), "WITH u AS (SELECT l_orderkey AS part, l_linenumber AS line, min(l_returnflag) AS rf, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2 HAVING min(l_quantity) > 12), r AS (SELECT part, line, CASE WHEN rf <> 'N' THEN rf END AS unit, CASE WHEN q > 30 THEN q % 2 END AS condition FROM u), s AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY part ORDER BY line) > 1 THEN 1 ELSE 0 END AS new FROM r), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY part ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM s), g AS (SELECT part, block, min(line) AS first_line, count(*) AS n_rows, count(DISTINCT unit) AS u, min(unit) AS unit, count(DISTINCT condition) AS c, min(condition) AS condition FROM b GROUP BY 1, 2), st AS (SELECT *, CASE WHEN c > 1 THEN 'conflicting_condition' WHEN u > 1 THEN 'mixed_units' WHEN c = 0 OR u = 0 THEN 'incomplete' ELSE 'ok' END AS status FROM g) SELECT part, block, first_line, n_rows, CASE WHEN status = 'ok' THEN unit END AS unit, CASE WHEN status = 'ok' THEN condition END AS condition, status FROM st"),
    "agg_square_law": (lambda s, d: _round(G.square_law(_law(s, d)), k=5, vth=4), "WITH p AS (SELECT l_suppkey AS curve, l_quantity / 5 + 3.2 AS v, l_discount AS dc FROM lineitem), q AS (SELECT curve, v, 0.8 * (v - 3) * (v - 3) * (1 + (dc - 0.05) / 10) AS i FROM p), g AS (SELECT curve, regr_slope(sqrt(i), v) AS s, regr_intercept(sqrt(i), v) AS b, count(*) AS n FROM q WHERE i > 0 GROUP BY 1) SELECT curve, round(s * s, 5) AS k, round(-b / nullif(s, 0), 4) AS vth, n FROM g"),
    "agg_pivot_vth": (lambda s, d: _round(G.pivot_vth(_law(s, d), _pivots(s, d)), k=3, vth=3, rms=3), stepwise_sql.PIVOT.format(law=_LAW_SQL, pivots=_PIVOTS_SQL)),
    "agg_coss_metrics": (lambda s, d: _round(G.coss_metrics(_clean(s, d), 400.0, ceiling=300.0), phi=3, m=3), stepwise_sql.COSS),
    "agg_fingerprints": (lambda s, d: _tokens(s, d).select("id", G.fingerprint(F.col("tokens")).alias("fingerprint"), F.size("tokens").alias("n_tokens")), f"WITH {_TOK} SELECT id, substr(sha256(array_to_string(list_sort(tokens), chr(10))), 1, 20) AS fingerprint, len(tokens) AS n_tokens FROM tok"),
    "agg_medoids": (lambda s, d: G.medoids(_tokens(s, d).withColumn("key", F.concat_ws("/", "key", (F.col("id") % 30).cast("string"))), "key"), f"WITH {_TOK}, k AS (SELECT concat(key, '/', id % 30) AS key, id, tokens FROM tok), n AS (SELECT key, count(*) AS n, min(id) AS least FROM k GROUP BY 1), s AS (SELECT a.key, a.id AS a, round(sum({_SIM}), 9) AS total, max(len(a.tokens)) AS size FROM k a JOIN k b ON a.key = b.key GROUP BY 1, 2), b AS (SELECT key, a FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY total DESC, size, a DESC) = 1) SELECT key, n, CASE WHEN n <= 2 THEN least ELSE a END AS medoid FROM n JOIN b USING (key)"),
    "agg_verdicts": (lambda s, d: G.verdicts(_gates(s, d)), "WITH g AS (SELECT o_orderkey AS entity, seq, CASE seq WHEN 1 THEN o_totalprice > 50000 WHEN 2 THEN CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus <> 'P' END ELSE true END AS passed FROM orders CROSS JOIN (SELECT unnest([1, 2, 3]) AS seq)), r AS (SELECT *, CASE WHEN passed IS NULL THEN concat('gate', seq, '_unevaluated') WHEN NOT passed THEN concat('failed_', seq) END AS reason FROM g) SELECT entity, count(*) AS n_gates, count(*) FILTER (coalesce(passed, false)) AS n_passed, CASE WHEN bool_and(coalesce(passed, false)) THEN 'accepted' ELSE 'rejected' END AS status, coalesce(string_agg(reason, ',' ORDER BY seq), '') AS reasons FROM r GROUP BY 1"),
    "agg_vendor_counts": (lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("p_type").alias("types"), F.count_distinct("p_name").alias("names")), "SELECT p_brand, count(*) AS members, count(DISTINCT p_type) AS types, count(DISTINCT p_name) AS names FROM part GROUP BY 1"),
    "agg_regression_diff": (lambda s, d: G.regression_summary(table(s, d, "orders").select(F.col("o_orderpriority").alias("method"), F.lit("grid").alias("source"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("part")), table(s, d, "orders").select(F.col("o_orderkey").alias("part"), F.when(F.col("o_orderkey") % 500 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status")))[1], "WITH w AS (SELECT o_orderkey AS part, CASE WHEN o_orderkey % 500 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders), g AS (SELECT o_orderkey AS part, o_orderstatus AS status FROM orders) SELECT *, 'unexpected' AS side FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM w) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM g)"),
    "agg_status_counts": (lambda s, d: G.regression_summary(table(s, d, "orders").select(F.col("o_orderpriority").alias("method"), F.lit("grid").alias("source"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("part")), table(s, d, "orders").select(F.col("o_orderkey").alias("part"), F.col("o_orderstatus").alias("status")))[0], "SELECT o_orderpriority AS method, 'grid' AS source, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2, 3"),
}
