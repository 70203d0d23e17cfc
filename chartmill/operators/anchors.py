"""Capacitance anchors from rows of specification tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import best_row

# Symbols, conditions, units and numbers as tables print them
NAMES = ("Ciss", "Coss", "Crss")
VDS, VDS_SIGNED = r"VDS\s*=\s*([0-9]+(?:\.[0-9]+)?)\s*V", r"VDS\s*=\s*(-?[0-9]+(?:\.[0-9]+)?)\s*V"
OTHER_UNIT = r"\b[nuµ]F\b"
ANY_NUMBER, PLAIN_NUMBER = r"(?<![A-Za-z])([-+]?[0-9]+(?:\.[0-9]+)?)", r"(?<![A-Za-z0-9.])([0-9]+(?:\.[0-9]+)?)"
BLOCK_GAP = 2


def _numbers(text: Column, pattern: str) -> Column:
    """Positive numbers of what stands before the unit."""
    before = F.when(F.contains(text, F.lit("pF")), F.substring_index(text, "pF", 1)).otherwise(text)
    return F.filter(F.transform(F.regexp_extract_all(before, F.lit(pattern), F.lit(1)), lambda x: x.cast("double")), lambda x: x > 0)


def typical(text: Column) -> Column:
    """One or two numbers: the first; three that rise: the middle one; anything else: none."""
    n = _numbers(text, PLAIN_NUMBER)
    return F.when(F.size(n).isin(1, 2), F.get(n, 0)).when((F.size(n) == 3) & (F.get(n, 0) < F.get(n, 1)) & (F.get(n, 1) < F.get(n, 2)), F.get(n, 1))


def capacitance_anchors(rows: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """rows (part, line, cells), fallback (part, vds) -> part, name, value_pf, vds_v, source.

    A row with its own value and voltage counts as it stands, later ones over earlier ones (source row). What is missing then is
    taken from contiguous blocks of capacitance rows (at most two lines apart) that name pF: unit and voltage hold for the whole
    block, which is refused if it names two voltages or one that isn't positive; without any, the part's fallback holds. Rows of
    another unit, and of more than three numbers, are refused (source block, the first row that serves)."""
    text = F.array_join(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: F.length(c) > 0), " ")
    r = rows.withColumn("_text", text)
    tail = lambda name: F.array_join(F.slice("cells", F.array_position("cells", name) + 1, F.size("cells")), " ")
    names = F.filter(F.array(*[F.lit(n) for n in NAMES]), lambda n: F.array_contains(F.col("cells"), n))
    named = r.withColumn("_names", names).where(F.size("_names") > 0)
    vds = F.nullif(F.regexp_extract("_text", VDS, 1), F.lit("")).cast("double")
    own = named.withColumn("name", F.explode("_names")).select("part", "line", "name", F.get(_numbers(tail(F.col("name")), ANY_NUMBER), 0).alias("value_pf"), vds.alias("vds_v"))
    own = best_row(own.where("value_pf IS NOT NULL AND vds_v IS NOT NULL"), ["part", "name"], F.desc("line")).select("part", "name", "value_pf", "vds_v", F.lit("row").alias("source"))
    w = Window.partitionBy("part").orderBy("line")
    b = named.withColumn("name", F.get("_names", F.lit(0))).withColumn("block", F.sum(F.when(F.col("line") - F.lag("line").over(w) > BLOCK_GAP, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = b.groupBy("part", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_text"))), lambda x: x["_text"]), " ").alias("all"))
    found = F.array_distinct(F.regexp_extract_all("all", F.lit(VDS_SIGNED), F.lit(1)))
    whole = whole.where(F.contains("all", F.lit("pF"))).withColumn("_vds", found)
    if fallback is not None:
        whole = whole.join(fallback.select("part", F.col("vds").alias("_else")), "part", "left")
    else:
        whole = whole.withColumn("_else", F.lit(None).cast("double"))
    whole = whole.withColumn("vds_v", F.when(F.size("_vds") == 0, F.col("_else")).when(F.size("_vds") == 1, F.get("_vds", F.lit(0)).cast("double"))).where("vds_v > 0")
    t = b.withColumn("_tail", tail(F.col("name"))).where(~F.col("_tail").rlike(OTHER_UNIT)).join(whole.select("part", "block", "vds_v"), ["part", "block"]).withColumn("value_pf", typical(F.col("_tail")))
    given = best_row(t.where("value_pf IS NOT NULL").select("part", "name", "line", "value_pf", "vds_v"), ["part", "name"], F.asc("line")).select("part", "name", "value_pf", "vds_v", F.lit("block").alias("source"))
    return own.unionByName(given.join(own.select("part", "name"), ["part", "name"], "left_anti"))
