"""Queries of text and number functions over captions built from parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.rules import Holds, first_kind_sql
from .adapters import CAPTIONS, caption_lines
from .curve_queries import _clean, _round
from .adapters import CLEAN
from ..session import table

_N = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[‐‑‒–—−]', '-', 'g'), '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_C = "regexp_replace(" + _N + ", '[^a-z0-9]+', '', 'g')"


def _bare(s, d):
    """Every fourth caption without its figure and part, so that whole-title formulas occur."""
    c = caption_lines(s, d)
    return c.withColumn("title", F.when(F.col("id") % 4 == 0, F.regexp_extract("title", r"^Figure \d+\. (.*) \w+ \w+$", 1)).otherwise(F.col("title")))


_BARE = CAPTIONS + ", bare AS (SELECT id, CASE WHEN id % 4 = 0 THEN regexp_extract(title, '^Figure \\d+\\. (.*) \\w+ \\w+$', 1) ELSE title END AS title, text FROM caps)"

_VIEWS = f"""WITH {_BARE}, n AS (SELECT id, title, {_N.format('title')} AS t, {_C.format('title')} AS tc, {_N.format('text')} AS p, {_C.format('text')} AS pc, {_N.format("concat(title, ' ', text)")} AS h, {_C.format("concat(title, ' ', text)")} AS hc FROM bare)"""
_ALONE = f"""WITH {_BARE}, n AS (SELECT id, title, {_N.format('title')} AS t, {_C.format('title')} AS tc, {_N.format('text')} AS p, {_C.format('text')} AS pc, {_N.format('title')} AS h, {_C.format('title')} AS hc FROM bare)"""
_TITLE_KIND = f""", k AS (SELECT *, {first_kind_sql([x for x in T.KINDS if x not in T.OWNERS], 'chart')} AS kind, {first_kind_sql(T.OWNERS, 'none')} AS owner, id % 1200 AS number FROM n)
 SELECT id, CASE WHEN kind = 'capacitances' AND owner <> 'none' THEN owner WHEN kind <> 'chart' AND (number < 900 OR contains(t, 'characteristics')) THEN kind END AS kind, CASE WHEN {Holds('tc', T.RESISTANCE_BY_CURRENT).sql()} THEN 'current' WHEN {Holds('tc', T.RESISTANCE_BY_TEMPERATURE).sql()} THEN 'temperature' END AS direction FROM k"""

QUERIES = {
    "text_chart_kind": (lambda s, d: _bare(s, d).select("id", T.chart_kind(F.col("title"), F.col("text")).alias("kind")), f"{_VIEWS} SELECT id, {first_kind_sql(T.KINDS, 'chart')} AS kind FROM n"),
    "text_title_kind": (lambda s, d: _bare(s, d).select("id", T.title_kind(F.col("title"), F.col("id") % 1200, F.col("text")).alias("kind"), T.resistance_direction(F.col("title")).alias("direction")), _ALONE + _TITLE_KIND),
    "text_title_gates": (lambda s, d: _bare(s, d).select("id", T.is_spec_header(F.col("title")).alias("spec_header"), T.is_marketing(F.col("title")).alias("marketing"), T.is_resistance_title(F.col("title")).alias("resistance"), T.figure_number(F.col("title")).alias("figure")), f"{_VIEWS} SELECT id, {T.SPEC_HEADER.sql()} AS spec_header, len(string_split(t, ' ')) >= 5 AND {(Holds('t', T.PURPOSE) & Holds('t', T.PROMISE)).sql()} AS marketing, {T.RESISTANCE['t'].sql()} AS resistance, TRY_CAST(nullif(regexp_extract(title, '(?i)^\\s*(?:fig(?:ure)?|diagram|chart)\\.?\\s*(\\d+)', 1), '') AS INT) AS figure FROM n"),
    "text_number_tokens": (lambda s, d: caption_lines(s, d).select("id", F.explode(T.number_tokens(F.concat_ws(" ", "text", F.concat(F.lit("10^"), (F.col("id") % 5 - 2).cast("string")), F.concat((F.col("id") % 90).cast("string"), F.lit("k"))))).alias("value")).groupBy("id").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n")), f"WITH {CAPTIONS}, x AS (SELECT id, unnest(regexp_extract_all(concat(text, ' 10^', id % 5 - 2, ' ', id % 90, 'k'), '(10\\^[-+]?[0-9]+|[-+]?[0-9]+(?:\\.[0-9]+)?[umkKMG]?)', 1)) AS k FROM caps) SELECT id, round(sum(CASE WHEN k LIKE '10^%' THEN pow(10.0, CAST(substr(k, 4) AS DOUBLE)) WHEN k LIKE '%k' THEN 1000 * CAST(rtrim(k, 'k') AS DOUBLE) WHEN k LIKE '%m' THEN 0.001 * CAST(rtrim(k, 'm') AS DOUBLE) ELSE CAST(k AS DOUBLE) END), 4) AS total, count(*) AS n FROM x GROUP BY 1"),
    "text_conditions": (lambda s, d: caption_lines(s, d).select("id", T.condition_voltage(F.when(F.col("id") % 3 == 0, F.concat(F.lit("VDS = 0 to "), (F.col("id") % 80).cast("string"), F.lit(" V"))).when(F.col("id") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("@ "), (F.col("id") % 60).cast("string"), F.lit(".5 V")))).alias("volts"), T.typical_pick(F.concat_ws(" ", F.when(F.col("id") % 4 > 0, F.col("id") % 7), F.when(F.col("id") % 4 > 1, F.col("id") % 11), F.when(F.col("id") % 4 > 2, F.col("id") % 13))).alias("typ"), T.one_unit(F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.lit("pF or nF")), ["pF", "nF", "uF"]).alias("unit")), f"WITH {CAPTIONS} SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id % 80 AS DOUBLE) WHEN id % 3 = 1 THEN CAST(regexp_extract(text, 'VDS = ([0-9]+) V', 1) AS DOUBLE) ELSE id % 60 + 0.5 END AS volts, CAST(CASE id % 4 WHEN 1 THEN id % 7 WHEN 2 THEN id % 7 WHEN 3 THEN CASE WHEN id % 7 <= id % 11 AND id % 11 <= id % 13 THEN id % 11 END END AS DOUBLE) AS typ, CASE WHEN id % 2 = 0 THEN 'pF' END AS unit FROM caps"),
    "text_temperatures": (lambda s, d: caption_lines(s, d).select("id", F.array_join(F.transform(T.temperatures(F.when(F.col("id") % 3 == 0, F.concat_ws(" ", "text", F.lit("TJ = -55 °C TJ=175°C"))).when(F.col("id") % 3 == 1, F.lit("25 °C")).otherwise(F.col("text"))), lambda x: x.cast("int").cast("string")), ",").alias("temps"), F.size(T.affected_traces(F.when(F.col("id") % 2 == 0, F.lit("coss_short_x_span")).otherwise(F.col("text")))).alias("n_traces"), T.safe_name(F.col("title")).alias("name")), f"WITH {CAPTIONS} SELECT id, CASE id % 3 WHEN 0 THEN '-55,175' WHEN 2 THEN '25,125' END AS temps, CASE WHEN id % 2 = 0 THEN 1 ELSE 3 END AS n_traces, trim(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS name FROM caps"),
    "number_laws": (lambda s, d: _round(_clean(s, d).select("curve", N.log_scale(F.col("y"), 2.5).alias("z"), N.from_log_scale(N.log_scale(F.col("y"), 2.5), 2.5).alias("back"), N.depletion(F.col("x"), 800.0, 1.0, 0.5).alias("c"), N.significant(F.col("x") * 1.37).alias("sig"), "x"), z=6, back=6, c=4, sig=6, x=6), f"WITH {CLEAN} SELECT curve, round(ln(1 + y / 2.5), 6) AS z, round(y, 6) AS back, round(800 / pow(1 + x, 0.5), 4) AS c, round(CASE WHEN x = 0 THEN 0 ELSE round(x * 1.37 * pow(10.0, 3 - floor(log10(abs(x * 1.37))))) / pow(10.0, 3 - floor(log10(abs(x * 1.37)))) END, 6) AS sig, round(x, 6) AS x FROM cl"),
    "number_bins": (lambda s, d: table(s, d, "part").select("p_partkey", N.cell(F.col("p_size") / 50, 8).alias("cell"), N.count_bin(F.col("p_size") % 40).alias("count_bin"), N.page_count_bin(F.col("p_size")).alias("pages_bin"), N.page_size(F.lit(560.0) + F.col("p_size") * 2, F.lit(780.0) + F.col("p_partkey") % 90).alias("size"), N.in_base_unit(F.col("p_retailprice"), F.element_at(F.array(F.lit("pF"), F.lit("nF"), F.lit("furlong")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("base")), "SELECT p_partkey, CAST(greatest(0, least(7, floor(p_size / 50.0 * 8))) AS INT) AS cell, CASE WHEN p_size % 40 = 0 THEN '0' WHEN p_size % 40 = 1 THEN '1' WHEN p_size % 40 <= 3 THEN '2-3' WHEN p_size % 40 <= 7 THEN '4-7' WHEN p_size % 40 <= 15 THEN '8-15' WHEN p_size % 40 <= 31 THEN '16-31' ELSE '32+' END AS count_bin, CASE WHEN p_size <= 4 THEN '1-4' WHEN p_size <= 8 THEN '5-8' WHEN p_size <= 12 THEN '9-12' WHEN p_size <= 16 THEN '13-16' WHEN p_size <= 24 THEN '17-24' ELSE '25+' END AS pages_bin, concat(CASE WHEN abs(560 + p_size * 2 - 595) < 25 AND abs(780 + p_partkey % 90 - 842) < 35 THEN 'a4' WHEN abs(560 + p_size * 2 - 612) < 25 AND abs(780 + p_partkey % 90 - 792) < 35 THEN 'letter' ELSE printf('r%.1f', round(greatest(560.0 + p_size * 2, 780.0 + p_partkey % 90) / least(560.0 + p_size * 2, 780.0 + p_partkey % 90), 1)::DOUBLE) END, '-', CASE WHEN 780 + p_partkey % 90 >= 560 + p_size * 2 THEN 'p' ELSE 'l' END) AS size, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1000 END AS base FROM part"),
}
