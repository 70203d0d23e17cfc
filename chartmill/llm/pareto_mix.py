"""Mixing sources to target weights by Pareto order sampling.

Every document first gets the whole copies that its source's rate (target words / words there)
makes certain. The remaining fraction is a sample without replacement: documents are ranked by
random odds over inclusion odds, and taken in that order while they fit into the words that are
left. Rounds repeat this for the documents that are small enough for the gap which the round
before left, so that one long document at the cut doesn't leave a source far from its target.

Nothing is gathered by source: a round sums sizes in SLICES slices of the ranking, finds the
slice of the cut from these sums, and orders only that slice's rows.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
sorted last; repeated doc_ids (and identical rows) are separate documents; an empty table gives no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, unit_hash, word_count, written

#: Parts of a source's ranking that are summed before the cut is looked for.
SLICES = 4096
#: No document is taken more often than this.
MOST_COPIES = 3
ROUNDS = 3
#: Source tables of at most so many rows (counted) are broadcast, so that a hot source's rows stay where they are.
SMALL_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes (source, size) -> source, source_size, target: all words dealt by weight, no source above MOST_COPIES times its own.

    The fixed point of "stop at the cap, reshare the excess" is one water level: sources by cap over
    weight, the full ones are a prefix, the rest share what is left by weight. Works on one row a source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = total.withColumn("w", w).withColumn("cap", (MOST_COPIES * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("level_here", left / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("level", F.min_by(F.when(F.col("cap") / F.col("w") > F.col("level_here"), F.col("level_here")), F.when(F.col("cap") / F.col("w") > F.col("level_here"), F.col("cap") / F.col("w"))).over(everything))
    return t.select("source", "source_size", F.least("cap", F.col("w") * F.coalesce("level", F.lit(float("inf")))).alias("target"))


def _fit(free: DataFrame, gaps: DataFrame, small: bool) -> DataFrame:
    """Of free (key .. source, size, rank_key, slice), the longest prefixes of the ranking that fit into gaps (source, gap)."""
    can = free.join(small_side(gaps, small), F.col("source").eqNullSafe(F.col("gap_source")), "inner").where((F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    sums = can.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    ordered = Window.partitionBy("source").orderBy("slice")
    sums = sums.withColumn("before", F.sum("words").over(ordered) - F.col("words")).where(F.col("before") <= F.col("gap"))
    sums = sums.select(F.col("source").alias("s"), F.col("slice").alias("k"), "before", (F.col("before") + F.col("words") > F.col("gap")).alias("cut"))
    near = can.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k")), "inner").drop("s", "k")
    row = Window.partitionBy("source", "slice").orderBy("rank_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    whole = near.where(~F.col("cut"))
    cut = near.where("cut").withColumn("upto", F.col("before") + F.sum("size").over(row)).where(F.col("upto") <= F.col("gap")).drop("upto")
    return whole.unionByName(cut).select("row", "source", "size")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, source, text, keep ...) -> doc_id, keep ..., size, source, source_size, target, copies, taken."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    twins = Window.partitionBy("doc_id", "digest").orderBy("source")
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("digest")).withColumn("twin", F.row_number().over(twins))
    base = base.withColumn("row", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("twin").cast("string")))
    base = written(base, "mix-base")
    targets = written(source_targets(base.select("source", "size"), weights), "mix-targets")
    small = targets.count() <= SMALL_SOURCES
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = base.join(small_side(t, small), F.col("source").eqNullSafe(F.col("t_source")), "inner").drop("t_source").withColumn("certain", F.least(F.floor(rate + 1e-9), F.lit(MOST_COPIES)).cast("bigint")).withColumn("share", F.greatest(rate - F.col("certain"), F.lit(0.0)))
    u = unit_hash("row", seed=seed)
    odds = (u / (1 - u)) / F.greatest(F.col("share") / (1 - F.least("share", F.lit(1 - 1e-9))), F.lit(1e-12))
    free = rows.where((F.col("share") > 0) & (F.col("size") > 0)).withColumn("rank_key", odds).withColumn("slice", F.floor(F.col("rank_key") / (1 + F.col("rank_key")) * SLICES))
    free = free.select("row", "doc_id", "source", "size", "rank_key", "slice")
    gaps = targets.select(F.col("source").alias("gap_source"), (F.col("target") - F.least(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) + 1e-9), F.lit(MOST_COPIES)) * F.col("source_size")).alias("gap"))
    chosen = None
    for k in range(ROUNDS):
        got = written(_fit(free if chosen is None else free.join(chosen.select("row"), "row", "left_anti"), gaps, small), f"mix-round{k}")
        chosen = got if chosen is None else chosen.unionByName(got)
        used = got.groupBy(F.col("source").alias("u_source")).agg(F.sum("size").alias("used"))
        gaps = gaps.join(used, F.col("gap_source").eqNullSafe(F.col("u_source")), "left").select("gap_source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
    out = rows.join(chosen.select("row", F.lit(1).alias("drawn")), "row", "left").withColumn("copies", F.col("certain") + F.coalesce("drawn", F.lit(0)))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    if keep:  # rows are drawn by their digests; the texts are joined once, in the end
        out = written(out.select("doc_id", "digest", "twin", "size", "source", "source_size", "target", "copies", "taken"), "mix-drawn")
        own = docs.select(F.col("doc_id").alias("_id"), digest.alias("_digest"), F.col("source").alias("_source"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
        same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("digest") == F.col("_digest"))
        if out.where("twin > 1").limit(1).count():
            own = own.withColumn("_twin", F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_source", F.xxhash64(*[f"_keep_{c}" for c in keep]))))
            same = same & (F.col("twin") == F.col("_twin"))
        out = own.join(out, same).select("doc_id", *[F.col(f"_keep_{c}").alias(c) for c in keep], "size", "source", "source_size", "target", "copies", "taken")
    return out.select("doc_id", *keep, "size", "source", "source_size", "target", "copies", "taken")
