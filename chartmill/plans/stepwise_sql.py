"""SQL of operators whose steps depend on the ones before them: recursion over a page, curve, panel or axis."""

from __future__ import annotations

from .adapters import BOXES, CLEAN

SUPPRESSION = f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM boxes),
 s(page, k, id, kept, accepted) AS (SELECT page, k, id, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}], true FROM o WHERE k = 1
  UNION ALL SELECT o.page, o.k, o.id, CASE WHEN t.hit THEN s.kept ELSE list_append(s.kept, {{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}}) END, NOT t.hit
  FROM s JOIN o ON o.page = s.page AND o.k = s.k + 1, LATERAL (SELECT len(list_filter(s.kept, lambda b: least(o.x1, b.x1) > greatest(o.x0, b.x0) AND least(o.y1, b.y1) > greatest(o.y0, b.y0)
   AND (least(o.x1, b.x1) - greatest(o.x0, b.x0)) * (least(o.y1, b.y1) - greatest(o.y0, b.y0)) > 0.2 * ((o.x1 - o.x0) * (o.y1 - o.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - (least(o.x1, b.x1) - greatest(o.x0, b.x0)) * (least(o.y1, b.y1) - greatest(o.y0, b.y0))))) > 0 AS hit) t)
 SELECT page, id, accepted FROM s"""

GREEDY = f"""WITH RECURSIVE {BOXES}, w AS (SELECT p_partkey // 50 AS grp, p_partkey AS lid, CAST((p_partkey * 71) % 560 AS DOUBLE) AS cx FROM part),
 j AS (SELECT grp, lid, id AS rid, abs(cx - x0) AS distance FROM w JOIN boxes ON page = grp WHERE abs(cx - x0) <= 60),
 o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY distance, lid, rid) AS k FROM j),
 s(grp, k, lid, rid, distance, ls, rs, used) AS (SELECT grp, k, lid, rid, distance, [lid], [rid], true FROM o WHERE k = 1
  UNION ALL SELECT o.grp, o.k, o.lid, o.rid, o.distance, CASE WHEN t.ok THEN list_append(s.ls, o.lid) ELSE s.ls END, CASE WHEN t.ok THEN list_append(s.rs, o.rid) ELSE s.rs END, t.ok
  FROM s JOIN o ON o.grp = s.grp AND o.k = s.k + 1, LATERAL (SELECT NOT list_contains(s.ls, o.lid) AND NOT list_contains(s.rs, o.rid) AS ok) t)
 SELECT grp, lid, rid, distance FROM s WHERE used"""

#: {strokes}: a CTE sk (panel, id, x0, y0, x1, y1).
CONNECTED = """WITH RECURSIVE {strokes}, e AS (SELECT a.panel, a.id AS a, b.id AS b FROM sk a JOIN sk b ON a.panel = b.panel AND a.id <> b.id
  WHERE least((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2, (a.x0 - b.x1) ** 2 + (a.y0 - b.y1) ** 2, (a.x1 - b.x0) ** 2 + (a.y1 - b.y0) ** 2, (a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) <= 1.5 * 1.5),
 r(panel, id, root) AS (SELECT panel, id, id FROM sk UNION SELECT r.panel, e.a, r.root FROM r JOIN e ON e.panel = r.panel AND e.b = r.id)
 SELECT panel, id, min(root) AS component FROM r GROUP BY 1, 2"""

CHAINS = """WITH RECURSIVE sg AS (SELECT panel, seg, seg * 10.0 AS x0, q % 3 AS y0, seg * 10.0 + 10 AS x1, (q * 7) % 3 AS y1 FROM (SELECT l_orderkey AS panel, CAST(l_linenumber AS BIGINT) AS seg, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)),
 en AS (SELECT panel, seg, round_even(x / 0.8, 0) AS gx, round_even(y / 0.8, 0) AS gy FROM (SELECT panel, seg, x0 AS x, y0 AS y FROM sg UNION ALL SELECT panel, seg, x1, y1 FROM sg)),
 e AS (SELECT DISTINCT a.panel, a.seg AS a, b.seg AS b FROM en a JOIN en b ON a.panel = b.panel AND a.gx = b.gx AND a.gy = b.gy AND a.seg <> b.seg),
 r(panel, seg, root) AS (SELECT panel, seg, seg FROM sg UNION SELECT r.panel, e.a, r.root FROM r JOIN e ON e.panel = r.panel AND e.b = r.seg)
 SELECT panel, seg, min(root) AS component FROM r GROUP BY 1, 2"""

#: {rules}: a CTE pk (page, k, jig).
GRID_REGIONS = """WITH RECURSIVE {rules}, g(page, k, jig, reps, grp) AS (SELECT page, k, jig, [jig], CAST(1 AS BIGINT) FROM pk WHERE k = 0
  UNION ALL SELECT p.page, p.k, p.jig, CASE WHEN t.at = 0 THEN list_append(g.reps, p.jig) ELSE g.reps END, CASE WHEN t.at = 0 THEN len(g.reps) + 1 ELSE t.at END
  FROM g JOIN pk p ON p.page = g.page AND p.k = g.k + 1, LATERAL (SELECT CAST(coalesce(list_position(list_transform(g.reps, lambda r: abs(r - p.jig) <= 6), true), 0) AS BIGINT) AS at) t)
 SELECT page, min(50.0 + jig)::DOUBLE AS x0, min(100.0 + k * 20)::DOUBLE AS y0, max(250.0 + jig)::DOUBLE AS x1, max(100.0 + k * 20)::DOUBLE AS y1, count(*) AS n_rules FROM g GROUP BY page, grp HAVING count(*) >= 4 AND max(k * 20) - min(k * 20) >= 60"""

TRACK = f"""WITH RECURSIVE {CLEAN}, xy AS (SELECT curve AS panel, round(x) AS x, list(y ORDER BY y) AS ys FROM cl GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY x) AS k FROM xy),
 s(panel, k, x, y, x1, y1, slope, missed, took) AS (SELECT panel, k, x, ys[1], x, ys[1], 0.0::DOUBLE, 0, true FROM o WHERE k = 1
  UNION ALL SELECT o.panel, o.k, o.x, t.y, CASE WHEN u.ok THEN o.x ELSE s.x1 END, CASE WHEN u.ok THEN t.y ELSE s.y1 END, CASE WHEN u.ok THEN (t.y - s.y1) / (o.x - s.x1) ELSE s.slope END, CASE WHEN u.ok THEN 0 ELSE s.missed + 1 END, u.ok
  FROM s JOIN o ON o.panel = s.panel AND o.k = s.k + 1, LATERAL (SELECT s.y1 + s.slope * (o.x - s.x1) AS want) q, LATERAL (SELECT list_min(list_transform(o.ys, lambda v: {{'d': abs(v - q.want), 'v': v}})).v AS y) t, LATERAL (SELECT abs(t.y - q.want) <= 60 AS ok) u WHERE s.missed <= 20)
 SELECT panel, round(x, 4) AS x, round(y, 4) AS y FROM s WHERE took"""

#: {shaped}: CTEs ending in src (axis, pixel, value). An axis has at most seven ticks here.
TRUSTED_SUBSET = """WITH {shaped}, t AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY pixel, value) - 1 AS i, count(*) OVER (PARTITION BY axis) AS n FROM src),
 m AS (SELECT axis, mask, count(*) AS size, regr_slope(value, pixel) AS m, regr_intercept(value, pixel) AS b, sqrt(greatest(regr_syy(value, pixel) - regr_sxy(value, pixel) * regr_sxy(value, pixel) / nullif(regr_sxx(value, pixel), 0), 0) / count(*)) AS off FROM t CROSS JOIN (SELECT unnest(range(1, 128)) AS mask) WHERE mask < (1 << n) AND (mask >> i) & 1 = 1 GROUP BY 1, 2 HAVING count(*) >= 4 AND count(DISTINCT pixel) >= 2),
 g AS (SELECT axis, size, round(m, 6) + 0.0 AS m, round(b, 4) + 0.0 AS b FROM m WHERE abs(m) > 1e-12 AND off / abs(m) <= 1.0),
 f AS (SELECT axis, size, count(DISTINCT (m, b)) AS models, min(m) AS m, min(b) AS b FROM g GROUP BY 1, 2 QUALIFY size = max(size) OVER (PARTITION BY axis))
 SELECT axis, coalesce(size, 0) AS n, CASE WHEN models = 1 THEN f.m END AS m, CASE WHEN models = 1 THEN f.b END AS b, CASE WHEN models IS NULL THEN 'no_subset' WHEN models = 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM (SELECT DISTINCT axis FROM src) LEFT JOIN f USING (axis)"""

_KNOTS = f"""{CLEAN}, li AS (SELECT curve, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys, greatest((max(x) - min(x)) * 0.01, 1e-6) AS scale, count(*) AS n FROM cl GROUP BY 1),
 lz AS (SELECT curve, n, scale, xs, ys, list_transform(xs, lambda v: ln(1 + v / scale)) AS z, list_transform(ys, lambda v: log10(v)) AS c FROM li),
 kn(curve, used, worst, added) AS (SELECT curve, [1, n], NULL::DOUBLE, NULL::BIGINT FROM lz
  UNION ALL SELECT q.curve, list_sort(list_append(q.used, q.top.i)), q.top.off, q.top.i FROM (SELECT k.curve, k.used, z.n, list_max(list_transform(range(1, z.n + 1), lambda i: {{'off': abs(pow(10.0, CASE WHEN list_contains(k.used, i) THEN z.c[i] ELSE
   z.c[list_max(list_filter(k.used, lambda u: u < i))] + (z.c[list_min(list_filter(k.used, lambda u: u > i))] - z.c[list_max(list_filter(k.used, lambda u: u < i))]) * (z.z[i] - z.z[list_max(list_filter(k.used, lambda u: u < i))]) / (z.z[list_min(list_filter(k.used, lambda u: u > i))] - z.z[list_max(list_filter(k.used, lambda u: u < i))]) END - z.c[i]) - 1), 'r': -i, 'i': i}})) AS top
   FROM kn k JOIN lz z USING (curve) WHERE k.worst IS NULL OR k.worst >= 0) q WHERE q.top.off > 0.02 AND len(q.used) < least(256, q.n)),
 ku AS (SELECT curve, arg_max(used, len(used)) AS used FROM kn GROUP BY 1),
 ke AS (SELECT curve, scale, unnest(used) AS i, xs, ys, z, c, used, n FROM ku JOIN lz USING (curve)),
 knots AS (SELECT curve, row_number() OVER (PARTITION BY curve ORDER BY i) - 1 AS knot, xs[i] AS x, ys[i] AS y, z[i] AS z, c[i] AS c, scale FROM ke),
 seg AS (SELECT *, lead(z) OVER w AS z1, lead(c) OVER w AS c1 FROM knots WINDOW w AS (PARTITION BY curve ORDER BY knot)),
 off AS (SELECT l.curve, max(abs(pow(10.0, s.c + (s.c1 - s.c) * (ln(1 + p.x / l.scale) - s.z) / (s.z1 - s.z) - log10(p.y)) - 1)) AS achieved FROM cl p JOIN lz l USING (curve) JOIN seg s ON s.curve = p.curve AND s.z1 IS NOT NULL AND ln(1 + p.x / l.scale) BETWEEN s.z AND s.z1 GROUP BY 1)"""

KNOTS = f"WITH RECURSIVE {_KNOTS} SELECT curve, knot, round(x, 4) AS x, round(y, 4) AS y, round(scale, 4) AS scale, round(achieved, 4) AS achieved FROM knots JOIN off USING (curve)"


def charge_table(samples: int) -> str:
    return f"""{_KNOTS}, gz AS (SELECT curve, scale, i, ln(1 + 400.0 / scale) * i / ({samples} - 1) AS pz FROM lz CROSS JOIN (SELECT unnest(range(0, {samples})) AS i)),
 ends AS (SELECT curve, arg_min(c, z) AS c0, min(z) AS z0, arg_max(c, z) AS c9, max(z) AS z9 FROM knots GROUP BY 1),
 gc AS (SELECT g.curve, g.i, g.scale * (exp(g.pz) - 1) AS v, pow(10.0, CASE WHEN g.pz <= e.z0 THEN e.c0 WHEN g.pz >= e.z9 THEN e.c9 ELSE s.c + (s.c1 - s.c) * (g.pz - s.z) / (s.z1 - s.z) END) AS c FROM gz g JOIN ends e USING (curve) ASOF LEFT JOIN (SELECT * FROM seg WHERE z1 IS NOT NULL) s ON s.curve = g.curve AND g.pz >= s.z),
 dq AS (SELECT *, coalesce(0.5 * (c + lag(c) OVER w) * (v - lag(v) OVER w), 0) AS q1, coalesce(0.5 * (c * v + lag(c) OVER w * lag(v) OVER w) * (v - lag(v) OVER w), 0) AS e1 FROM gc WINDOW w AS (PARTITION BY curve ORDER BY i)),
 tab AS (SELECT curve, i, v, c, sum(q1) OVER u AS q, sum(e1) OVER u AS e FROM dq WINDOW u AS (PARTITION BY curve ORDER BY i ROWS UNBOUNDED PRECEDING))"""


CHARGE_TABLE = f"WITH RECURSIVE {charge_table(64)} SELECT curve, CAST(i AS INT) AS i, round(v, 4) AS v, round(c, 4) AS c, round(q, 4) AS q, round(e, 4) AS e FROM tab"
SPICE = f"WITH RECURSIVE {charge_table(16)} SELECT curve, concat('.func qoss_c', curve, '(v) {{table(max(v,0), ', string_agg(concat(printf('%.9g', v), ',', printf('%.9e', q * 1e-12)), ', ' ORDER BY i), ')}}', chr(10), 'B_COSS_c', curve, ' d s I=ddt(qoss_c', curve, '(V(d,s)))', chr(10)) AS netlist FROM tab GROUP BY curve"

#: {law}: CTEs ending in q (curve, v, i); {pivots}: a CTE pv (curve, vpl, id_pl).
PIVOT = """WITH RECURSIVE {law}, {pivots}, good AS (SELECT curve, i AS x, max(v) AS y FROM q WHERE i > 0 GROUP BY 1, 2), sz AS (SELECT curve, count(*) AS n, min(x) AS x9, arg_min(y, x) AS y9 FROM good GROUP BY 1),
 w AS (SELECT pv.curve, vpl, id_pl, n, x9, y9, greatest(0.05 * id_pl, 0.02 * tp) AS i_lo, least(2.0 * id_pl, 0.85 * tp) AS i_hi FROM pv JOIN (SELECT curve, max(i) AS tp FROM q GROUP BY 1) USING (curve) LEFT JOIN sz USING (curve)),
 st AS (SELECT *, CASE WHEN i_hi <= 1.5 * i_lo THEN 'short_current_span' WHEN coalesce(n, 0) < 8 THEN 'too_few_points' ELSE 'ok' END AS status FROM w),
 gr AS (SELECT curve, x9, y9, i_lo + (i_hi - i_lo) * k / 159 AS px FROM st CROSS JOIN (SELECT unnest(range(0, 160)) AS k) WHERE status = 'ok'),
 sg AS (SELECT *, lead(x) OVER u AS nx, lead(y) OVER u AS ny FROM good WINDOW u AS (PARTITION BY curve ORDER BY x)),
 mt AS (SELECT gr.curve, px, CASE WHEN sg.x IS NULL THEN y9 WHEN nx IS NULL THEN y ELSE y + (ny - y) * (px - sg.x) / (nx - sg.x) END AS v FROM gr ASOF LEFT JOIN sg ON sg.curve = gr.curve AND gr.px >= sg.x),
 li AS (SELECT curve, vpl, id_pl, list(px ORDER BY px) AS ci, list(mt.v ORDER BY px) AS cv FROM mt JOIN st USING (curve) GROUP BY 1, 2, 3),
 gs(curve, k, a, b) AS (SELECT curve, 0, 0.05 * vpl, 0.95 * vpl FROM li
  UNION ALL SELECT s.curve, s.k + 1, CASE WHEN r.c < r.d THEN s.a ELSE t.c END, CASE WHEN r.c < r.d THEN t.d ELSE s.b END FROM gs s JOIN li l ON l.curve = s.curve AND s.k < 80, LATERAL (SELECT s.b - (sqrt(5.0) - 1) / 2 * (s.b - s.a) AS c, s.a + (sqrt(5.0) - 1) / 2 * (s.b - s.a) AS d) t,
  LATERAL (SELECT sqrt(list_avg(list_transform(range(1, 161), lambda n: pow(t.c + pow(l.ci[n] / (l.id_pl / pow(l.vpl - t.c, 2)), 0.5) - l.cv[n], 2)))) AS c, sqrt(list_avg(list_transform(range(1, 161), lambda n: pow(t.d + pow(l.ci[n] / (l.id_pl / pow(l.vpl - t.d, 2)), 0.5) - l.cv[n], 2)))) AS d) r),
 f AS (SELECT curve, (a + b) / 2 AS vth FROM gs WHERE k = 80)
 SELECT st.curve, status, round(vth, 3) AS vth, round(st.id_pl / pow(st.vpl - vth, 2), 3) AS k, round(sqrt(list_avg(list_transform(range(1, 161), lambda n: pow(vth + pow(ci[n] / (st.id_pl / pow(st.vpl - vth, 2)), 0.5) - cv[n], 2)))), 3) AS rms, round(i_lo, 4) AS i_lo, round(i_hi, 4) AS i_hi FROM st LEFT JOIN f USING (curve) LEFT JOIN li USING (curve)"""

#: {points}: a CTE pt (curve, x, y); every curve has 60 points at x = 0..59 in a box 0, 0, 59, 400, so windows have 8 points.
PLATEAU = """WITH {points}, li AS (SELECT curve, list(y ORDER BY x) AS ys FROM pt GROUP BY 1),
 cw AS (SELECT curve, i, (i + 3.5) / 59.0 AS rel, list_aggregate(ys[i + 1 : i + 8], 'quantile_cont', 0.9) AS hi, list_aggregate(ys[i + 1 : i + 8], 'quantile_cont', 0.1) AS lo, list_aggregate(ys[i + 1 : i + 8], 'median') AS md, CASE WHEN i >= 4 THEN list_aggregate(ys[1 : i], 'quantile_cont', 0.9) END AS bf, CASE WHEN 60 - i - 8 >= 4 THEN list_aggregate(ys[i + 9 : 60], 'quantile_cont', 0.1) END AS af FROM li CROSS JOIN (SELECT unnest(range(0, 52)) AS i)),
 ca AS (SELECT *, 3.0 * (7 / 59.0) / ((hi - lo) / 400 + 0.01) + least(bf - md, md - af) / 400 - 8.0 * rel AS score FROM cw WHERE rel BETWEEN 0.04 AND 0.78 AND bf - md >= 20 AND md - af >= 20),
 ba AS (SELECT *, max(score) OVER (PARTITION BY curve) AS best FROM ca),
 pk AS (SELECT * FROM ba QUALIFY row_number() OVER (PARTITION BY curve ORDER BY CASE WHEN score >= 0.7 * best THEN 0 ELSE 1 END, rel) = 1),
 ps AS (SELECT curve, CAST(x AS INT) + 1 AS e, count(*) OVER w AS k, sum(x - 29.5) OVER w AS su, sum(y) OVER w AS sv, sum((x - 29.5) ** 2) OVER w AS suu, sum((x - 29.5) * y) OVER w AS suv, sum(y * y) OVER w AS svv FROM (SELECT curve, x, y - avg(y) OVER (PARTITION BY curve) AS y FROM pt) WINDOW w AS (PARTITION BY curve ORDER BY x ROWS UNBOUNDED PRECEDING)),
 pz AS (SELECT * FROM ps UNION ALL SELECT DISTINCT curve, 0, 0, 0, 0, 0, 0, 0 FROM ps),
 sd AS (SELECT h.curve, l.e AS a, h.e AS b, h.k - l.k AS k, h.su - l.su AS su, h.sv - l.sv AS sv, h.suu - l.suu AS suu, h.suv - l.suv AS suv, h.svv - l.svv AS svv FROM pz h JOIN pz l ON l.curve = h.curve AND l.e + 8 <= h.e),
 se AS (SELECT curve, a, b, greatest(svv - sv * sv / k - (suv - su * sv / k) ** 2 / (suu - su * su / k), 0) AS off FROM sd),
 tr AS (SELECT f.curve, f.b AS i, m.b AS j, round(f.off + m.off + l.off, 6) AS cost FROM se f JOIN se m ON m.curve = f.curve AND f.a = 0 AND m.a = f.b JOIN se l ON l.curve = f.curve AND l.a = m.b AND l.b = 60 WHERE f.b < 44 AND m.b < 52 AND f.b / 59.0 BETWEEN 0.05 AND 0.60 AND m.b / 59.0 BETWEEN 0.18 AND 0.88),
 ml AS (SELECT t.curve, list_avg(ys[i + 1 : j]) AS mid FROM (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY curve ORDER BY cost, i, j) = 1) t JOIN li USING (curve))
 SELECT li.curve, round(CASE WHEN md IS NULL OR (mid IS NOT NULL AND hi - lo > 4 AND abs(mid - md) > 14) THEN mid ELSE md END, 4) AS y_px, CASE WHEN md IS NULL AND mid IS NULL THEN NULL WHEN md IS NULL OR (mid IS NOT NULL AND hi - lo > 4 AND abs(mid - md) > 14) THEN 'middle' ELSE 'window' END AS source FROM li LEFT JOIN pk USING (curve) LEFT JOIN ml USING (curve)"""

_FIT = "(s.y0 * pow((1 + s.x0 / {p}) / (1 + s.xs[n] / {p}), {m}))"
_D_M = "(" + _FIT.format(p="s.phi", m="s.m") + " * ln((1 + s.x0 / s.phi) / (1 + s.xs[n] / s.phi)))"
_D_PHI = "(" + _FIT.format(p="s.phi", m="s.m") + " * s.m * (s.xs[n] / (s.phi * s.phi) / (1 + s.xs[n] / s.phi) - s.x0 / (s.phi * s.phi) / (1 + s.x0 / s.phi)))"


def _total(expr: str) -> str:
    return f"list_sum(list_transform(range(1, len(s.xs) + 1), lambda n: {expr}))"


#: Charge and energy to 400 V with the depletion law fitted by damped Gauss-Newton steps, ceiling 300.
COSS = f"""WITH RECURSIVE {CLEAN}, o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY curve) AS n, y >= 300 * 0.98 AS over_, min(x) OVER (PARTITION BY curve) AS first_x, max(x) OVER (PARTITION BY curve) AS last_x FROM cl WINDOW w AS (PARTITION BY curve ORDER BY x)),
 c1 AS (SELECT curve, max(n) AS n, min(i) FILTER (NOT over_) AS k FROM o GROUP BY 1), c2 AS (SELECT curve, CASE WHEN k > 0 AND k < n - 2 THEN k ELSE 0 END AS clear FROM c1),
 f AS (SELECT o.curve, x, y, i - clear AS i, n - clear AS n, clear FROM o JOIN c2 USING (curve) WHERE i >= clear), e1 AS (SELECT curve, max(x) FILTER (i = 0) AS x0, max(y) FILTER (i = 0) AS y0, max(x) FILTER (i = least(n - 1, 6)) AS x6 FROM f GROUP BY 1),
 e2 AS (SELECT f.*, x0, y0, x <= CASE WHEN x0 > 0 THEN greatest(x0 * 10, x6) ELSE x6 END AS low FROM f JOIN e1 USING (curve)), e3 AS (SELECT *, count(*) FILTER (low) OVER (PARTITION BY curve) AS nl FROM e2),
 l AS (SELECT curve, x0, y0, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM e3 WHERE low OR (nl < 3 AND i < 6) GROUP BY 1, 2, 3),
 gn(curve, x0, y0, xs, ys, k, phi, m, lam, best, done) AS (SELECT curve, x0, y0, xs, ys, 0, 1.0::DOUBLE, 0.5::DOUBLE, 1e-3::DOUBLE, list_sum(list_transform(range(1, len(xs) + 1), lambda n: pow(y0 * pow((1 + x0) / (1 + xs[n]), 0.5) - ys[n], 2))), len(xs) < 3 FROM l
  UNION ALL SELECT curve, x0, y0, xs, ys, k + 1, CASE WHEN e < best THEN p2 ELSE phi END, CASE WHEN e < best THEN m2 ELSE m END, CASE WHEN e < best THEN lam / 3 ELSE lam * 4 END, CASE WHEN e < best THEN e ELSE best END, CASE WHEN e < best THEN best - e <= 1e-14 * best ELSE lam * 4 > 1e12 END
  FROM (SELECT s.*, {_total("pow(" + _FIT.format(p="s.p2", m="s.m2") + " - s.ys[n], 2)")} AS e
   FROM (SELECT t.*, greatest(0.3, least(3.0, phi + (b * g1 - h * g2) / (a * b - h * h))) AS p2, greatest(0.3, least(0.6, m + (a * g2 - h * g1) / (a * b - h * h))) AS m2
    FROM (SELECT s.*, {_total(f"{_D_PHI} * {_D_PHI}")} * (1 + s.lam) + s.lam * 1e-12 AS a, {_total(f"{_D_M} * {_D_M}")} * (1 + s.lam) + s.lam * 1e-12 AS b, {_total(f"{_D_PHI} * {_D_M}")} AS h, {_total(f"{_D_PHI} * (s.ys[n] - " + _FIT.format(p="s.phi", m="s.m") + ")")} AS g1, {_total(f"{_D_M} * (s.ys[n] - " + _FIT.format(p="s.phi", m="s.m") + ")")} AS g2 FROM gn s WHERE NOT s.done AND s.k < 200) t) s) z),
 ft AS (SELECT curve, arg_max(phi, k) AS phi, arg_max(m, k) AS m FROM gn GROUP BY 1),
 gr AS (SELECT curve, j, 400.0 * j / 3999 AS g FROM c2 CROSS JOIN (SELECT unnest(range(0, 4000)) AS j)),
 sa AS (SELECT curve, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM o WINDOW w AS (PARTITION BY curve ORDER BY x)),
 en AS (SELECT curve, arg_min(y, x) AS y_first FROM o GROUP BY 1),
 iv AS (SELECT gr.curve, j, g, CASE WHEN sa.x IS NULL THEN y_first WHEN nx IS NULL THEN y ELSE y + (ny - y) * (g - sa.x) / (nx - sa.x) END AS drawn FROM gr JOIN en USING (curve) ASOF LEFT JOIN sa ON sa.curve = gr.curve AND gr.g >= sa.x),
 cv AS (SELECT iv.curve, j, g, clear, CASE WHEN g >= x0 THEN drawn WHEN clear > 0 THEN greatest(y0 * pow(1 + x0 / phi, m) / pow(1 + g / phi, m), drawn) ELSE y0 * pow(1 + x0 / phi, m) / pow(1 + g / phi, m) END AS c FROM iv JOIN e1 USING (curve) JOIN ft USING (curve) JOIN c2 USING (curve)),
 dq AS (SELECT curve, clear, (g + lag(g) OVER w) / 2 AS mid, (c + lag(c) OVER w) / 2 * (g - lag(g) OVER w) AS q, (c * g + lag(c) OVER w * lag(g) OVER w) / 2 * (g - lag(g) OVER w) AS e FROM cv WINDOW w AS (PARTITION BY curve ORDER BY j)),
 sm AS (SELECT d.curve, max(clear) > 0 AS clipped, sum(q) AS q, sum(e) AS e, coalesce(sum(q) FILTER (mid < first_x), 0) AS below, coalesce(sum(q) FILTER (mid >= first_x AND mid <= last_x), 0) AS chart, coalesce(sum(q) FILTER (mid > last_x), 0) AS above FROM dq d JOIN (SELECT DISTINCT curve, first_x, last_x FROM o) USING (curve) GROUP BY 1)
 SELECT curve, round(q, 4) AS qoss, round(e, 4) AS eoss, round(q / 400, 4) AS co_tr, round(2 * e / 160000, 4) AS co_er, round(below, 4) AS q_below, round(chart, 4) AS q_chart, round(above, 4) AS q_above, round(phi, 3) AS phi, round(m, 3) AS m, round(CASE WHEN q > 0 THEN below / q ELSE 0 END, 4) AS extrapolated_fraction, clipped FROM sm JOIN ft USING (curve)"""


def _alike(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END)"


#: {pages}: CTEs ending in pp (id, role, mode, tokens).
CLUSTERS = f"""WITH RECURSIVE {{pages}}, fp AS (SELECT concat_ws('|', role, mode) AS coarse, id, tokens, substr(sha256(array_to_string(list_sort(list_distinct(tokens)), chr(10))), 1, 20) AS f FROM pp),
 d AS (SELECT coarse, f, list_distinct(arg_min(tokens, id)) AS t, count(*) AS n, min(id) AS low, max(id) AS high FROM fp GROUP BY 1, 2), o AS (SELECT *, {{{{'f': f, 't': t, 'n': n, 'low': low, 'high': high}}}} AS g, row_number() OVER (PARTITION BY coarse ORDER BY n DESC, low) AS k FROM d),
 s(coarse, k, cl) AS (SELECT coarse, k, [{{{{'g': [g], 't': t, 'id': CASE WHEN n <= 2 THEN low ELSE high END}}}}] FROM o WHERE k = 1
  UNION ALL SELECT coarse, k, CASE WHEN place <= len(cl) THEN list_concat(list_append(cl[1 : place - 1], made), cl[place + 1 : len(cl)]) ELSE list_append(cl, made) END
  FROM (SELECT *, CASE WHEN list_sum(list_transform(ng, lambda a: a.n)) <= 2 THEN {{{{'g': ng, 't': list_min(list_transform(ng, lambda a: {{{{'low': a.low, 't': a.t}}}})).t, 'id': list_min(list_transform(ng, lambda a: a.low))}}}} ELSE {{{{'g': ng, 't': top.t, 'id': top.h}}}} END AS made
   FROM (SELECT *, list_max(list_transform(ng, lambda a: {{{{'s': list_sum(list_transform(ng, lambda b: b.n * {_alike('a.t', 'b.t')})), 'l': -len(a.t), 'h': a.high, 't': a.t}}}})) AS top
    FROM (SELECT *, CASE WHEN place <= len(cl) THEN list_append(cl[place].g, g) ELSE [g] END AS ng
     FROM (SELECT *, CASE WHEN list_max(sims) >= 0.72 THEN list_max(list_transform(range(1, len(sims) + 1), lambda i: CASE WHEN sims[i] = list_max(sims) THEN i END)) ELSE len(cl) + 1 END AS place
      FROM (SELECT o.coarse, o.k, o.g, s.cl, list_transform(s.cl, lambda c: {_alike('c.t', 'o.t')}) AS sims FROM s JOIN o ON o.coarse = s.coarse AND o.k = s.k + 1) q1) q2) q3) q4) q5),
 z AS (SELECT coarse, unnest(arg_max(cl, k)) AS c FROM s GROUP BY 1), r AS (SELECT coarse, c, row_number() OVER (PARTITION BY coarse ORDER BY list_sum(list_transform(c.g, lambda a: a.n)) DESC, c.id) AS cluster FROM z), u AS (SELECT coarse, cluster, c.id AS medoid, unnest(c.g).f AS f FROM r)
 SELECT fp.id, coarse, cluster, medoid FROM fp JOIN u USING (coarse, f)"""
