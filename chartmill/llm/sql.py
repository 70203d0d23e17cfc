"""DuckDB SQL of the queries that SQL expresses, over the whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle are counted: for small tables.
OP5 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents),
 e AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0), s AS (SELECT DISTINCT rid, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END, ' ') AS g FROM e), n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2), l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 r(rid, root) AS (SELECT rid, rid FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.rid), c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.root GROUP BY 1)
 SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN c USING (rid)"""


def _round(k: int) -> str:
    """The k-th round: of the documents that are left and fit the gap, the prefix of the ranking that fits."""
    return f"""u{k} AS (SELECT f.row, f.source, f.size, sum(f.size) OVER (PARTITION BY f.source ORDER BY rk, doc_id, f.size ROWS UNBOUNDED PRECEDING) <= gap AS ok FROM f{k} f JOIN g{k} g ON f.source IS NOT DISTINCT FROM g.source WHERE f.size <= gap),
 c{k} AS (SELECT row, source, size FROM u{k} WHERE ok), f{k + 1} AS (SELECT * FROM f{k} WHERE row NOT IN (SELECT row FROM c{k})), g{k + 1} AS (SELECT g.source, gap - coalesce((SELECT sum(size) FROM c{k} c WHERE c.source IS NOT DISTINCT FROM g.source), 0) AS gap FROM g{k} g)"""


OP10 = f"""WITH b AS (SELECT doc_id, source, coalesce(len({_WORDS.format('text')}), 0) AS size, md5(coalesce(text, '')) AS digest FROM documents), r AS (SELECT *, concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), ''), digest, row_number() OVER (PARTITION BY doc_id, digest ORDER BY source NULLS FIRST)) AS row FROM b),
 s AS (SELECT source, sum(size)::DOUBLE AS total, 3 * sum(size)::DOUBLE AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM b GROUP BY source),
 l AS (SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM s),
 t AS (SELECT source, total, least(cap, w * coalesce(arg_min(CASE WHEN cap / w > here THEN here END, CASE WHEN cap / w > here THEN cap / w END) OVER (), 'infinity'::DOUBLE)) AS target FROM l),
 q AS (SELECT r.*, total, target, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source), v AS (SELECT *, CAST(least(floor(rate + 1e-9), 3) AS BIGINT) AS certain, (CAST('0x' || substr(md5('0' || chr(31) || row), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM q),
 f0 AS (SELECT row, doc_id, source, size, (u / (1 - u)) / greatest((rate - certain) / (1 - least(rate - certain, 1 - 1e-9)), 1e-12) AS rk FROM v WHERE rate - certain > 0 AND size > 0),
 g0 AS (SELECT source, target - least(floor(CASE WHEN total > 0 THEN target / total ELSE 0 END + 1e-9), 3) * total AS gap FROM t), {_round(0)}, {_round(1)}, {_round(2)},
 drawn AS (SELECT row FROM c0 UNION ALL SELECT row FROM c1 UNION ALL SELECT row FROM c2)
 SELECT doc_id, size, CAST(total AS BIGINT) AS source_size, round(target, 6) AS target, CAST((certain + CASE WHEN drawn.row IS NULL THEN 0 ELSE 1 END) * size AS BIGINT) AS taken FROM v LEFT JOIN drawn USING (row)"""

SQL = {"op5_jaccard": OP5, "op10_mixing": OP10}
