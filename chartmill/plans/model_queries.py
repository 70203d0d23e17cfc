"""Queries of validation ladders, charge models, trace identity, temperature laws and layouts."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import aggregate as G
from ..operators import models as D
from ..operators import validate as V
from ..session import table
from . import stepwise_sql
from .curve_queries import CLEAN, _clean, _round
from .match_queries import _TOK, _tokens


def _m(col, k, scale, null=0):
    """A number from a key by modulus; null for every null-th key."""
    c = (F.col(col) * k % 101) / F.lit(101.0) * scale
    return F.when(F.col(col) % null != 0, c) if null else c


def _ms(k, scale, null=0):
    c = f"(o_orderkey * {k} % 101) / 101.0::DOUBLE * {scale}"
    return f"CASE WHEN o_orderkey % {null} <> 0 THEN {c} END" if null else c


def _evidence(s, d):
    o = table(s, d, "orders")
    k = "o_orderkey"
    return o.select(
        F.col(k).alias("id"), (F.col(k) % 13 != 0).alias("metrics"), _m(k, 7, 0.3, 17).alias("extrapolated"), (F.col(k) % 5 == 0).alias("clipped"),
        F.when(F.col(k) % 3 == 0, "Qoss table reference unavailable").when(F.col(k) % 7 == 0, "Qoss").alias("error"), F.when(F.col(k) % 11 == 0, "pass").when(F.col(k) % 11 == 1, "fail").alias("tail"), (F.col(k) % 2 == 0).alias("table_reference"),
        _m(k, 31, 500.0, 6).alias("coer"), _m(k, 37, 80.0, 9).alias("coer_v"), _m(k, 41, 600.0, 19).alias("got"), (F.col(k) % 4 == 0).alias("any_integral"), F.when(F.col(k) % 8 != 0, "pass").otherwise("suspect").alias("trace_status"),
        F.when(F.col(k) % 10 != 0, 1.0).alias("anchor"), (_m(k, 53, 0.4, 23) - 0.2).alias("relative"), F.when(F.col(k) % 29 == 0, "anchor_inside_trace_gap").alias("refused"), "o_totalprice",
    )


_EV = f"""ev AS (SELECT o_orderkey AS id, o_orderkey % 13 <> 0 AS metrics, {_ms(7, 0.3, 17)} AS extrapolated, o_orderkey % 5 = 0 AS clipped, CASE WHEN o_orderkey % 3 = 0 THEN 'Qoss table reference unavailable' WHEN o_orderkey % 7 = 0 THEN 'Qoss' END AS error, CASE o_orderkey % 11 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS tail, o_orderkey % 2 = 0 AS table_reference,
 {_ms(31, 500.0, 6)} AS coer, {_ms(37, 80.0, 9)} AS coer_v, {_ms(41, 600.0, 19)} AS got, o_orderkey % 4 = 0 AS any_integral, CASE WHEN o_orderkey % 8 <> 0 THEN 'pass' ELSE 'suspect' END AS trace_status, CASE WHEN o_orderkey % 10 <> 0 THEN 1.0 END AS anchor, {_ms(53, 0.4, 23)} - 0.2 AS relative, CASE WHEN o_orderkey % 29 = 0 THEN 'anchor_inside_trace_gap' END AS refused, o_totalprice FROM orders),
 q AS (SELECT *, CASE WHEN NOT metrics THEN NULL WHEN tail = 'pass' THEN 'pass_vendor_qoss_curve_tail' WHEN extrapolated > 0.2 THEN 'unreliable_extrapolation' WHEN error = 'Qoss table reference unavailable' THEN CASE WHEN clipped THEN 'chart_clipped_reference_unavailable' ELSE 'reference_unavailable' END WHEN clipped AND error IS NOT NULL THEN CASE WHEN table_reference THEN 'chart_clipped_table_authoritative' ELSE 'chart_clipped_reference_unavailable' END WHEN clipped THEN 'clipped_chart_completed' WHEN error IS NULL THEN 'pass' ELSE 'graph_table_inconsistent' END AS charge,
 CASE WHEN coer IS NULL OR coer <= 0 THEN 'coer_reference_unavailable' WHEN coer_v IS NULL OR coer_v <= 0 THEN 'coer_reference_condition_voltage_unavailable' WHEN NOT metrics THEN 'coer_energy_integral_unavailable' WHEN coalesce(extrapolated, 1) > 0.2 THEN 'coer_unreliable_extrapolation' WHEN clipped THEN 'coer_chart_clipped' WHEN got IS NULL OR got <= 0 THEN 'coer_energy_integral_unavailable' WHEN abs(got - coer) / coer > 0.25 THEN 'coer_graph_table_inconsistent' ELSE 'pass_coer_energy' END AS energy,
 CASE WHEN any_integral THEN 'integral_reference_present_anchor_only_not_applicable' WHEN trace_status <> 'pass' THEN 'anchor_only_trace_validation_not_pass' WHEN anchor IS NULL THEN 'anchor_only_no_coss_anchor' WHEN refused IS NOT NULL OR relative IS NULL THEN 'anchor_only_coss_anchor_unusable' WHEN abs(relative) > 0.1 THEN 'anchor_only_coss_anchor_inconsistent' ELSE 'coss_anchor_only' END AS anchored FROM ev),
 fin AS (SELECT *, CASE WHEN NOT (charge IS NULL OR charge IN ('reference_unavailable', 'chart_clipped_reference_unavailable')) THEN charge WHEN energy = 'pass_coer_energy' THEN energy WHEN anchored = 'coss_anchor_only' THEN anchored ELSE charge END AS final FROM q)"""


def ladder(s, d):
    c = F.col
    e = _evidence(s, d)
    e = e.withColumn("charge", V.charge_status(c("metrics"), c("extrapolated"), c("clipped"), c("error"), c("tail"), c("table_reference"))).withColumn("energy", V.energy_status(c("coer"), c("coer_v"), c("metrics"), c("extrapolated"), c("clipped"), c("got"))).withColumn("anchored", V.anchor_status(c("any_integral"), c("trace_status"), c("anchor"), c("relative"), c("refused")))
    return e.withColumn("final", V.final_tier(c("charge"), c("energy"), c("anchored")))


def _traces(s, d):
    o = table(s, d, "orders")
    k = "o_orderkey"
    cols = [F.col(k).alias("id"), (F.col(k) % 2 == 0).alias("vector"), _m(k, 3, 60.0).alias("common_samples"), (F.col(k) % 4).alias("rank_swaps"), (0.9 + _m(k, 5, 0.1)).alias("crss_bottom"), (F.col(k) % 6 != 0).alias("ciss_flatter")]
    for i, t in enumerate(V.TRACES):
        cols += [F.when(F.col(k) % (9 + i) != 0, F.floor(_m(k, 11 + i, 40.0))).alias(f"{t}_points"), F.when(F.col(k) % (9 + i) != 0, 0.5 + _m(k, 17 + i, 0.5)).alias(f"{t}_span"), F.floor(_m(k, 23 + i, 20.0)).alias(f"{t}_y_range"), _m(k, 29 + i, 0.4, 7).alias(f"{t}_rise")]
    return o.select(*cols)


def _trace_sql() -> str:
    cols = ["o_orderkey AS id", "o_orderkey % 2 = 0 AS vector", f"{_ms(3, 60.0)} AS common_samples", "o_orderkey % 4 AS rank_swaps", f"0.9 + {_ms(5, 0.1)} AS crss_bottom", "o_orderkey % 6 <> 0 AS ciss_flatter"]
    for i, t in enumerate(V.TRACES):
        cols += [f"CASE WHEN o_orderkey % {9 + i} <> 0 THEN floor({_ms(11 + i, 40.0)}) END AS {t}_points", f"CASE WHEN o_orderkey % {9 + i} <> 0 THEN 0.5 + {_ms(17 + i, 0.5)} END AS {t}_span", f"floor({_ms(23 + i, 20.0)}) AS {t}_y_range", f"{_ms(29 + i, 0.4, 7)} AS {t}_rise"]
    rules = ["CASE WHEN Crss_points IS NOT NULL AND (NOT vector OR (least(Ciss_span, Coss_span) >= 0.98 AND coalesce(Crss_span, 0) >= 0.85)) AND greatest(Ciss_span, Coss_span) >= 0.65 AND greatest(Ciss_span, Coss_span) - coalesce(Crss_span, 0) > 0.12 THEN 'Crss_peer_relative_short_x_span' END"]
    for t in V.TRACES:
        rules += [f"CASE WHEN {t}_points IS NULL THEN 'missing_{t}' END", f"CASE WHEN {t}_points < 8 THEN '{t}_too_few_points' END", f"CASE WHEN {t}_points IS NOT NULL AND coalesce({t}_span, 0) < 0.65 THEN '{t}_short_x_span' END", f"CASE WHEN {t}_points IS NOT NULL AND coalesce({t}_y_range, 0) <= 2 AND coalesce({t}_span, 0) >= CASE WHEN vector THEN 0.9 ELSE 0.8 END THEN '{t}_flat_full_span_unverified' END", f"CASE WHEN {t}_points IS NOT NULL AND {t}_rise > 0.25 THEN '{t}_rises_with_vds_unphysical' END"]
    rules += ["CASE WHEN common_samples < 20 THEN 'too_few_common_samples' END", "CASE WHEN rank_swaps NOT IN (0, 1) THEN 'ciss_coss_rank_swap_count' END", "CASE WHEN crss_bottom < 0.95 THEN 'crss_not_bottom' END", "CASE WHEN NOT ciss_flatter THEN 'ciss_not_flatter_than_coss' END"]
    return f"WITH t AS (SELECT {', '.join(cols)} FROM orders), r AS (SELECT id, concat_ws(',', {', '.join(rules)}) AS reasons FROM t) SELECT id, reasons, CASE WHEN reasons = '' THEN 'pass' ELSE 'suspect' END AS status FROM r"


def trace_validation(s, d):
    t = _traces(s, d).withColumn("r", V.trace_reasons())
    return t.select("id", F.array_join("r", ",").alias("reasons"), V.status_of(F.col("r")).alias("status"))


def _residuals(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("panel"))
    t = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(V.TRACES)]))
    g = p.select("panel", t.alias("t")).select("panel", "t", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(n).alias("q")) for j, n in enumerate(V.TRACES)])).alias("u"))
    same = (F.col("t.i") + F.col("panel") % 3) % 3 == F.col("u.j")
    off = ((F.col("panel") * 13 + F.col("t.i") * 7 + F.col("u.j") * 5) % 29) / F.lit(290.0)
    r = F.when((F.col("panel") + F.col("t.i") + F.col("u.j")) % 11 != 0, F.when(same, off).otherwise(off + 0.6))
    return g.where("(panel + u.j) % 7 <> 0").select("panel", F.col("t.n").alias("trace"), F.col("u.q").alias("quantity"), r.alias("log_ratio"))


_PERMS = "(VALUES " + ", ".join(f"('{','.join(p)}', '{q}', '{t}')" for p in itertools.permutations(V.TRACES) for q, t in zip(V.TRACES, p, strict=True)) + ") AS pe(assignment, quantity, trace)"
_BASE = ",".join(V.TRACES)
_ASSIGN = f"""WITH nm AS (SELECT * FROM (VALUES (0, 'Ciss'), (1, 'Coss'), (2, 'Crss')) AS n(i, n)), g AS (SELECT p_partkey AS panel, a.n AS trace, b.n AS quantity, a.i AS ti, b.i AS uj, ((p_partkey * 13 + a.i * 7 + b.i * 5) % 29) / 290.0::DOUBLE AS off FROM part CROSS JOIN nm a CROSS JOIN nm b WHERE (p_partkey + b.i) % 7 <> 0),
 r AS (SELECT panel, trace, quantity, CASE WHEN (panel + ti + uj) % 11 <> 0 THEN CASE WHEN (ti + panel % 3) % 3 = uj THEN off ELSE off + 0.6 END END AS lr FROM g),
 s AS (SELECT panel, assignment, count(lr) AS n, coalesce(sqrt(avg(lr * lr)), 0) + 0.5 * (count(*) - count(lr)) AS score, sqrt(avg(lr * lr)) AS rms, max(abs(lr)) AS worst FROM r JOIN {_PERMS} USING (quantity, trace) GROUP BY 1, 2),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY panel ORDER BY round(score, 9), CASE WHEN assignment = '{_BASE}' THEN 0 ELSE 1 END, assignment) = 1),
 f AS (SELECT b.*, x.score AS base_score, CASE WHEN b.assignment = '{_BASE}' THEN 'baseline_best' WHEN b.n < 2 THEN 'insufficient_anchor_coverage' WHEN x.score - b.score < 0.12 THEN 'improvement_too_small' WHEN b.rms > 0.18 THEN 'best_anchor_fit_too_poor' WHEN b.worst > 0.25 THEN 'anchor_outlier_prevents_relabel' ELSE 'anchor_evidence_selected' END AS reason FROM b JOIN s x ON x.panel = b.panel AND x.assignment = '{_BASE}')
 SELECT panel, reason, CASE WHEN reason = 'anchor_evidence_selected' THEN assignment ELSE '{_BASE}' END AS assignment, round(score, 6) AS score, round(base_score, 6) AS base_score, n FROM f"""


def _transfer(s, d):
    """Square-law transfer curves of a part at 25 and 125 degrees, and their anchors."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("part"), (2 + F.col("p_size") / 25).alias("vth"))
    grid = p.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(60))))
    hot = F.explode(F.array(F.lit(25.0), F.lit(125.0)))
    c = grid.select("part", "vth", "n", hot.alias("temp")).withColumn("i", F.col("n") * 2.0)
    k = F.when(F.col("temp") > 25, 3.2).otherwise(4.0)
    v = F.col("vth") - F.when(F.col("temp") > 25, 0.3).otherwise(0.0) + F.sqrt(F.col("i") / k)
    curves = c.where("part % 9 <> 0 OR temp = 25").select("part", "temp", "i", v.alias("v"))
    a = p.select("part", F.lit(25.0).alias("tref"), "vth", F.lit(4.0).alias("k"), F.lit(2.0).alias("p"), F.lit(50.0).alias("id_gc"), (F.col("vth") + F.sqrt(F.lit(12.5)) + F.when(F.col("part") % 7 == 0, 0.5).otherwise(0.0)).alias("vpl"))
    return D.temperature_law(curves, a)


_LAW = """WITH pt AS (SELECT p_partkey AS part, 2 + p_size / 25.0::DOUBLE AS vth FROM part),
 cu AS (SELECT part, temp, 2.0::DOUBLE * n AS i, vth - CASE WHEN temp > 25 THEN 0.3 ELSE 0 END + sqrt(2.0 * n / CASE WHEN temp > 25 THEN 3.2 ELSE 4.0 END) AS v FROM pt CROSS JOIN (SELECT unnest(range(1, 61)) AS n) CROSS JOIN (SELECT unnest([25, 125]) AS temp) WHERE part % 9 <> 0 OR temp = 25),
 st AS (SELECT part, vth, CASE WHEN part % 9 = 0 THEN 'no_hotter_curve' WHEN part % 7 = 0 THEN 'anchor_off_pivot' ELSE 'ok' END AS status FROM pt),
 g AS (SELECT part, vth, j, 5 + (least(100, 0.85 * 120) - 5) * j / 119.0::DOUBLE AS i FROM st CROSS JOIN (SELECT unnest(range(0, 120)) AS j) WHERE status = 'ok'),
 b AS (SELECT g.part, g.vth, j, g.i, temp, max(CASE WHEN c.i <= g.i THEN c.i END) AS x0, arg_max(c.v, CASE WHEN c.i <= g.i THEN c.i END) AS y0, min(CASE WHEN c.i >= g.i THEN c.i END) AS x1, arg_min(c.v, CASE WHEN c.i >= g.i THEN c.i END) AS y1 FROM g JOIN cu c ON c.part = g.part GROUP BY 1, 2, 3, 4, 5),
 v AS (SELECT part, vth, j, i, temp, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x1 > x0 THEN y0 + (y1 - y0) * (i - x0) / (x1 - x0) ELSE y0 END AS v FROM b),
 m AS (SELECT part, vth, j, sqrt(i / 4.0) AS ov, max(CASE WHEN temp = 125 THEN v END) - max(CASE WHEN temp = 25 THEN v END) AS d, max(CASE WHEN temp = 25 THEN v END) AS vc FROM v GROUP BY 1, 2, 3, 4),
 f AS (SELECT part, regr_intercept(d, ov) AS dv, regr_slope(d, ov) AS sh, sqrt(greatest(regr_syy(d, ov) - regr_sxy(d, ov) * regr_sxy(d, ov) / regr_sxx(d, ov), 0) / 120) AS rms, sqrt(avg((vth + ov - vc) * (vth + ov - vc))) AS cold_rms FROM m GROUP BY 1)
 SELECT part, status, round(dv / 100, 6) AS d_vth_per_k, round(-2 * ln(1 + sh) / 100, 6) AS d_log_k_per_k, round(rms, 3) AS rms, round(cold_rms, 3) AS cold_rms, CASE WHEN -dv / sh > 0 THEN round(4 * pow(-dv / sh, 2), 3) END AS ztc_a FROM st LEFT JOIN f USING (part)"""


def _pages(s, d):
    """pages as layouts: the url's host is the vendor, counts of tags in bins are the tokens."""
    p = table(s, d, "pages")
    n = lambda tag: F.regexp_count("html", F.lit("<" + tag + "[ >]"))
    tags = ["p", "li", "b", "h1", "br", "table", "img", "div"]
    t = p.select(F.col("page_id").cast("string").alias("id"), F.regexp_extract("url", r"^https?://(?:[^/.]+\.)?([^/.]+)\.example", 1).alias("doc"), F.col("page_id").alias("page"), *[n(x).cast("bigint").alias(f"n_{x}") for x in tags], F.col("html"))
    role = F.when((F.col("n_table") > 0) & (F.col("n_li") > 6), "mixed").when(F.col("n_table") > 0, "table").when(F.col("n_p") > 8, "chart").otherwise("other")
    mode = F.when(F.col("n_b") > 2, "hybrid").otherwise("native")
    tokens = F.array_sort(F.array(*[F.concat(F.lit(f"{x}:"), N.count_bin(F.col(f"n_{x}"))) for x in tags], F.concat(F.lit("role:"), role), F.concat(F.lit("mode:"), mode)))
    return t.select("id", "doc", "page", role.alias("role"), mode.alias("mode"), tokens.alias("tokens"))


_BIN = "CASE WHEN {0} = 0 THEN '0' WHEN {0} = 1 THEN '1' WHEN {0} <= 3 THEN '2-3' WHEN {0} <= 7 THEN '4-7' WHEN {0} <= 15 THEN '8-15' WHEN {0} <= 31 THEN '16-31' ELSE '32+' END"
_TAGS = ["p", "li", "b", "h1", "br", "table", "img", "div"]
_PG = "pg AS (SELECT page_id, url, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]')) AS n_{t}" for t in _TAGS) + " FROM pages), pl AS (SELECT CAST(page_id AS VARCHAR) AS id, regexp_extract(url, '^https?://(?:[^/.]+\\.)?([^/.]+)\\.example', 1) AS doc, page_id AS page, CASE WHEN n_table > 0 AND n_li > 6 THEN 'mixed' WHEN n_table > 0 THEN 'table' WHEN n_p > 8 THEN 'chart' ELSE 'other' END AS role, CASE WHEN n_b > 2 THEN 'hybrid' ELSE 'native' END AS mode, [" + ", ".join(f"concat('{t}:', " + _BIN.format(f"n_{t}") + ")" for t in _TAGS) + "] AS tg FROM pg), pp AS (SELECT id, doc, page, role, mode, list_sort(list_concat(tg, ['role:' || role, 'mode:' || mode])) AS tokens FROM pl)"


def _clusters(s, d):
    p = _pages(s, d)
    return D.cluster_layouts(p.select(F.concat_ws("|", "role", "mode").alias("coarse"), "id", G.fingerprint(F.col("tokens")).alias("fingerprint"), "tokens"))


def _segments(s, d):
    li = table(s, d, "lineitem")
    x, y = F.col("l_linenumber") * 10.0, F.col("l_quantity")
    return li.groupBy(F.col("l_orderkey").alias("panel"), F.col("l_linenumber").cast("long").alias("seg")).agg(F.min("l_quantity").alias("q")).select("panel", "seg", (F.col("seg") * 10.0).alias("x0"), (F.col("q") % 3).alias("y0"), (F.col("seg") * 10.0 + 10).alias("x1"), ((F.col("q") * 7) % 3).alias("y1"))


def _gate_charge(s, d):
    """Drawn gate-charge curves of parts, 60 pixel columns each: steep, flat, steep, with a ripple; and their boxes."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("curve"), (8 + F.col("p_size") % 15).alias("a"), (10 + F.col("p_partkey") % 17).alias("w"), (F.col("p_partkey") % 5 * 0.6).alias("s"))
    k = F.col("k")
    v = F.when(k < F.col("a"), 7.0 * k).when(k < F.col("a") + F.col("w"), 7.0 * F.col("a") + F.col("s") * (k - F.col("a"))).otherwise(7.0 * F.col("a") + F.col("s") * F.col("w") + 5.0 * (k - F.col("a") - F.col("w")))
    pts = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(59)))).select("curve", k.cast("double").alias("x"), (400.0 - v + (k * 7 + F.col("curve") * 13) % 11 / 8).alias("y"))
    return pts, p.select("curve", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 59.0), ("y1", 400.0))])


_GATE_CHARGE = "pp AS (SELECT p_partkey AS curve, 8 + p_size % 15 AS a, 10 + p_partkey % 17 AS w, p_partkey % 5 * 0.6::DOUBLE AS s FROM part), pt AS (SELECT curve, k::DOUBLE AS x, 400.0::DOUBLE - CASE WHEN k < a THEN 7.0 * k WHEN k < a + w THEN 7.0 * a + s * (k - a) ELSE 7.0 * a + s * w + 5.0 * (k - a - w) END + (k * 7 + curve * 13) % 11 / 8.0 AS y FROM pp CROSS JOIN (SELECT unnest(range(0, 60)) AS k))"


def _knots(s, d):
    return D.adaptive_knots(_clean(s, d))


_ORD = "rk AS (SELECT p, lv, c, yy, row_number() OVER (PARTITION BY p, lv ORDER BY yy, c) AS k FROM (SELECT l_suppkey AS p, l_linenumber AS lv, l_returnflag AS c, sum(l_quantity) AS yy FROM lineitem GROUP BY 1, 2, 3)), od AS (SELECT p, lv, string_agg(c, ',' ORDER BY k) AS o FROM rk GROUP BY 1, 2), cn AS (SELECT p, o, count(*) AS n FROM od GROUP BY 1, 2)"

QUERIES = {
    "valid_traces": (trace_validation, _trace_sql()),
    "valid_charge_ladder": (lambda s, d: ladder(s, d).select("id", "charge", "energy", "anchored", "final"), f"WITH {_EV} SELECT id, charge, energy, anchored, final FROM fin"),
    "valid_served": (lambda s, d: V.served(ladder(s, d).select("id", "final", F.col("got").alias("co_er"), F.col("o_totalprice").alias("qoss")), "final", ["co_er", "qoss"]), f"WITH {_EV}, o AS (SELECT id, final, got AS co_er, o_totalprice AS qoss, coalesce(final IN ('pass', 'pass_vendor_qoss_curve_tail', 'clipped_chart_completed', 'pass_coer_energy', 'coss_anchor_only'), false) AS ok FROM fin) SELECT id, final, CASE WHEN ok THEN co_er END AS co_er, CASE WHEN ok THEN qoss END AS qoss, CASE WHEN NOT ok THEN co_er END AS diagnostic_co_er, CASE WHEN NOT ok THEN qoss END AS diagnostic_qoss FROM o"),
    "valid_charge_error": (lambda s, d: _evidence(s, d).select("id", V.charge_error({"Qoss": F.col("got"), "Co_er": F.col("coer")}, {"Qoss": F.col("coer"), "Co_er": F.col("coer_v") * 5}, F.col("extrapolated")).alias("error")), f"WITH {_EV} SELECT id, CASE WHEN coer IS NULL AND coer_v IS NULL THEN 'Qoss table reference unavailable' ELSE nullif(concat_ws(';', CASE WHEN extrapolated > 0.2 THEN 'extrapolated' END, CASE WHEN abs(got - coer) / nullif(coer, 0) > 0.25 THEN 'Qoss' END, CASE WHEN abs(coer - coer_v * 5) / nullif(coer_v * 5, 0) > 0.25 THEN 'Co_er' END), '') END AS error FROM ev"),
    "valid_small_ladders": (lambda s, d: _evidence(s, d).select("id", V.scale_verdict(F.col("id") % 3, F.col("relative"), F.col("refused").isNotNull(), F.when(F.col("id") % 6 != 0, F.col("id") % 4 != 0)).alias("scale"), V.breakdown_status(F.col("got"), F.col("coer"), F.col("clipped")).alias("breakdown"), V.gate_charge_status(F.col("metrics"), F.when(F.col("id") % 5 != 1, "nC"), F.col("id") % 7 == 0, F.col("id") % 9 == 0, F.col("extrapolated") * 3).alias("gate"), V.drive_status(F.element_at(F.array(F.lit("10"), F.lit("-4/+18"), F.lit(None).cast("string"), F.lit("4.5"), F.lit("3")), (F.col("id") % 5 + 1).cast("int")), F.when(F.col("id") % 2 == 0, "GaN device")).alias("drive"), V.ztc_status(F.col("coer"), F.col("got")).alias("ztc"), V.panel_status(F.col("metrics"), F.col("trace_status"), F.col("clipped")).alias("panel"), V.plausible_plateau(F.col("coer_v")).alias("plateau"), V.anchor_floor(F.col("coer_v"), F.col("coer") / 20, F.col("id") % 3 == 0).alias("floor"), V.trusted_axis(F.when(F.col("id") % 5 > 0, "grid").when(F.col("id") % 10 > 0, "chart_text"), F.col("anchor"), F.col("coer"), F.col("error")).alias("axis")), f"""WITH {_EV} SELECT id, CASE WHEN coalesce(abs(relative) > 0.1, false) OR refused IS NOT NULL THEN 'FAIL' WHEN id % 6 <> 0 AND id % 4 = 0 THEN 'incomplete' WHEN id % 3 > 0 THEN 'verified' ELSE 'unverified' END AS scale,
 CASE WHEN got IS NULL OR coer IS NULL OR coer = 0 THEN 'anchor_unavailable' WHEN clipped AND abs(got / coer - 1) > 0.02 THEN 'anchor_mismatch' WHEN got / coer - 1 < -0.02 THEN 'below_minimum' ELSE 'ok' END AS breakdown,
 CASE WHEN NOT metrics OR id % 5 = 1 THEN 'unresolved' WHEN id % 7 = 0 THEN 'axis_assumed' WHEN id % 9 = 0 THEN 'axis_grid_inferred' WHEN coalesce(extrapolated * 3, 0) < 0.5 THEN 'low_confidence' ELSE 'ok' END AS gate,
 CASE id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'drive_not_numeric' WHEN 2 THEN 'drive_missing' WHEN 3 THEN CASE WHEN id % 2 = 0 THEN 'drive_too_low_for_gan' ELSE 'ok' END ELSE 'drive_too_low' END AS drive,
 CASE WHEN coer IS NULL AND got IS NULL THEN 'no_crossing' WHEN coer IS NULL OR got IS NULL THEN 'one_sided' WHEN abs(got / nullif(coer, 0) - 1) > 0.2 THEN 'disagree' ELSE 'ok' END AS ztc,
 CASE WHEN NOT metrics THEN 'unverified' WHEN trace_status = 'pass' AND NOT clipped THEN 'ok' WHEN trace_status = 'pass' THEN 'overlay-review-required' ELSE 'unverified' END AS panel, coalesce(abs(coer_v) BETWEEN 1 AND 12, false) AS plateau,
 CASE WHEN id % 3 = 0 THEN 'resolved' WHEN least(coer_v, coer / 20) IS NULL THEN 'unknown' WHEN least(coer_v, coer / 20) < 4 THEN 'unresolved' ELSE 'resolved' END AS floor,
 id % 5 > 0 AND anchor IS NOT NULL AND coer IS NOT NULL AND error IS NULL AS axis FROM ev"""),
    "valid_source_policy": (lambda s, d: V.untrusted_source(table(s, d, "part").select("p_partkey", F.col("p_brand").alias("vendor"), F.when(F.col("p_size") > 10, "ok").otherwise("unresolved").alias("status"), F.array(F.lit("seen")).alias("diagnostics")), s.createDataFrame([("brand#3",), ("BRAND#7",)], "vendor string")).select("p_partkey", "vendor", "status", F.array_join("diagnostics", ",").alias("diagnostics")), "SELECT p_partkey, p_brand AS vendor, CASE WHEN p_size > 10 THEN CASE WHEN p_brand IN ('Brand#3', 'Brand#7') THEN 'source_untrusted' ELSE 'ok' END ELSE 'unresolved' END AS status, CASE WHEN p_size > 10 AND p_brand IN ('Brand#3', 'Brand#7') THEN 'seen,source_collection_not_part_specific' ELSE 'seen' END AS diagnostics FROM part"),
    "valid_stable_order": (lambda s, d: V.stable_order(table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("panel"), F.col("l_linenumber").alias("level"), F.col("l_returnflag").alias("curve")).agg(F.sum("l_quantity").alias("y")), 4), f"WITH {_ORD} SELECT p AS panel, CASE WHEN n >= 4 THEN o END AS \"order\", n FROM cn QUALIFY row_number() OVER (PARTITION BY p ORDER BY n DESC, o) = 1"),
    "model_trace_assignment": (lambda s, d: _round(D.assign_traces(_residuals(s, d), s.createDataFrame([], "panel long, assignment string, prior double")), score=6, base_score=6), _ASSIGN),
    "model_temperature_law": (lambda s, d: _round(_transfer(s, d), d_vth_per_k=6, d_log_k_per_k=6, rms=3, cold_rms=3, ztc_a=3), _LAW),
    "model_adaptive_knots": (lambda s, d: _round(_knots(s, d)), stepwise_sql.KNOTS),
    "model_charge_table": (lambda s, d: _round(D.charge_table(_knots(s, d), 400.0, 64)), stepwise_sql.CHARGE_TABLE),
    "model_spice_text": (lambda s, d: D.spice_text(D.charge_table(_knots(s, d), 400.0, 16)), stepwise_sql.SPICE),
    "model_plateau": (lambda s, d: _round(D.plateau(*_gate_charge(s, d))), stepwise_sql.PLATEAU.format(points=_GATE_CHARGE)),
    "model_chain_segments": (lambda s, d: D.chain_segments(_segments(s, d)), stepwise_sql.CHAINS),
    "layout_pages": (lambda s, d: _pages(s, d).select("id", "doc", "page", "role", "mode", F.array_join("tokens", " ").alias("tokens"), G.fingerprint(F.col("tokens")).alias("fingerprint")), f"WITH {_PG} SELECT id, doc, page, role, mode, array_to_string(tokens, ' ') AS tokens, substr(sha256(array_to_string(list_sort(list_distinct(tokens)), chr(10))), 1, 20) AS fingerprint FROM pp"),
    "layout_clusters": (_clusters, stepwise_sql.CLUSTERS.format(pages=_PG)),
    "layout_documents": (lambda s, d: D.document_signatures(_pages(s, d).withColumn("layout", F.concat_ws("-", "role", "mode"))), f"""WITH {_PG}, z AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc) AS n FROM pp),
 t AS (SELECT doc, concat('pages:', CASE WHEN n <= 4 THEN '1-4' WHEN n <= 8 THEN '5-8' WHEN n <= 12 THEN '9-12' WHEN n <= 16 THEN '13-16' WHEN n <= 24 THEN '17-24' ELSE '25+' END) AS t FROM z UNION SELECT doc, concat_ws(':', 'page-role', CAST(least(4, i * 5 // greatest(n, 1)) AS BIGINT), role, mode) FROM z UNION SELECT doc, concat('layout:', role, '-', mode) FROM z WHERE role <> 'other'
 UNION SELECT doc, concat('role-count:', role, ':', {_BIN.format('count(*)')}) FROM z GROUP BY doc, role UNION SELECT doc, concat('mode-count:', mode, ':', {_BIN.format('count(*)')}) FROM z GROUP BY doc, mode), g AS (SELECT doc, string_agg(t, chr(10) ORDER BY t) AS tokens FROM t GROUP BY 1) SELECT doc, n_pages, tokens, substr(sha256(tokens), 1, 20) AS fingerprint FROM g JOIN (SELECT doc, count(*) AS n_pages FROM pp GROUP BY 1) USING (doc)"""),
}
__all__ = ["QUERIES", "CLEAN", "_TOK", "_tokens"]
