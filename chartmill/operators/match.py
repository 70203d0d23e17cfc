"""Joins of boxes, labels, curves and sets: containment, suppression, nearest, greedy one-to-one, similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x0", "y0", "x1", "y1")}


def contained(words: DataFrame, panels: DataFrame) -> DataFrame:
    """words (page, word, cx, cy) inside panels (page, panel, x0..y1): an equi-join on page with range predicates."""
    return words.join(panels, "page").where("cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1").select("page", "panel", "word")


def overlapping_pairs(boxes: DataFrame, least_iou: float) -> DataFrame:
    """Pairs of boxes of a page with their IoU and overlap of the smaller."""
    a, b = (boxes.select("page", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "x0", "y0", "x1", "y1")]) for s in "ab")
    p = a.join(b, "page").where("a_id < b_id AND a_x0 < b_x1 AND b_x0 < a_x1 AND a_y0 < b_y1 AND b_y0 < a_y1")
    p = p.withColumn("iou", N.iou(box("a_"), box("b_"))).withColumn("of_smaller", N.overlap_of_smaller(box("a_"), box("b_")))
    return p.where(F.col("iou") >= least_iou).select("page", "a_id", "b_id", "iou", "of_smaller")


def suppress(boxes: DataFrame, most_iou: float = 0.45) -> DataFrame:
    """Greedy suppression: in order of seq, a box stays unless it overlaps an accepted one of its page by more than most_iou.

    The verdict on a box depends on those before it, so pages are processed whole (panels of one page)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "id"])
        kept: list[tuple] = []
        flags = []
        for r in pdf.itertuples():
            ok = True
            for k in kept:
                w, h = min(r.x1, k.x1) - max(r.x0, k.x0), min(r.y1, k.y1) - max(r.y0, k.y0)
                if w > 0 and h > 0:
                    i = w * h
                    union = (r.x1 - r.x0) * (r.y1 - r.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - i
                    if i > most_iou * union:
                        ok = False
                        break
            flags.append(ok)
            if ok:
                kept.append(r)
        return pdf.assign(accepted=flags)[["page", "id", "accepted"]]

    return boxes.groupBy("page").applyInPandas(run, "page long, id long, accepted boolean")


def nearest(left: DataFrame, right: DataFrame, key: str, distance: Column, most: float | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """For each left row (lid), the right row (rid) at least distance in its group; ties by `order`, then rid. Rows without one are left out."""
    j = left.join(right, key).withColumn("distance", distance)
    if most is not None:
        j = j.where(F.col("distance") <= most)
    w = Window.partitionBy(key, "lid").orderBy(F.round("distance", 9), *order, "rid")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, "lid", "rid", "distance")


def mutual_nearest(pairs: DataFrame, margin: float) -> DataFrame:
    """pairs (grp, lid, rid, distance): bindings that are best for both sides, and better than either side's runner-up by `margin`."""
    by_left, by_right = Window.partitionBy("grp", "lid").orderBy("distance", "rid"), Window.partitionBy("grp", "rid").orderBy("distance", "lid")
    r = pairs.withColumn("_l", F.row_number().over(by_left)).withColumn("_r", F.row_number().over(by_right)).withColumn("_nl", F.lead("distance").over(by_left)).withColumn("_nr", F.lead("distance").over(by_right))
    clear = lambda c: F.coalesce(F.col(c) - F.col("distance") >= margin, F.lit(True))
    return r.where("_l = 1 AND _r = 1").where(clear("_nl") & clear("_nr")).select("grp", "lid", "rid", "distance")


def greedy_match(pairs: DataFrame, most: float) -> DataFrame:
    """pairs (grp, lid, rid, distance): by ascending distance, each label and curve is used once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, out = set(), set(), []
        for r in pdf[pdf.distance <= most].sort_values(["distance", "lid", "rid"]).itertuples():
            if r.lid not in used_l and r.rid not in used_r:
                used_l.add(r.lid)
                used_r.add(r.rid)
                out.append((r.grp, r.lid, r.rid, r.distance))
        return pd.DataFrame(out, columns=["grp", "lid", "rid", "distance"])

    return pairs.groupBy("grp").applyInPandas(run, "grp long, lid long, rid long, distance double")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def tasks(rows: DataFrame) -> int:
    """Tasks for steps that compute much from few bytes, which adaptive execution would put into one."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(left: DataFrame, right: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """left x right within a key, for small rows: a key's pairs are dealt to `parts` places. right's columns, the key apart, are named otherwise."""
    a = left.withColumn("_part", F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.lit(parts)))
    b = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    n = tasks(left)
    return a.repartition(n, key, "_part").join(b.repartition(n, key, "_part"), [key, "_part"]).drop("_part")


def similar_pairs(rows: DataFrame, key: str, least: float, block: int = 1000) -> DataFrame:
    """rows (key, id, tokens): pairs within a key that share a token and are `least` alike.

    Sets are compared once each, however many rows hold them; the rows of two alike sets, in blocks of ids, are then paired."""
    held = rows.select(key, "id", F.array_sort(F.array_distinct("tokens")).alias("t")).where("id IS NOT NULL AND size(array_compact(t)) > 0")
    held = held.withColumn("_b", F.floor((F.row_number().over(Window.partitionBy(key, "t").orderBy("id")) - 1) / block))
    sets = held.groupBy(key, "t", "_b").agg(F.collect_list("id").alias("ids"))
    one = sets.select(key, "t").distinct()
    common = F.size(F.array_intersect(F.array_compact("ta"), F.array_compact("tb")))
    near = dealt(one.withColumnRenamed("t", "ta"), one.withColumnRenamed("t", "tb"), key).where("ta <= tb").withColumn("_n", common).where("_n > 0")
    near = near.withColumn("similarity", F.col("_n") / (F.size("ta") + F.size("tb") - F.col("_n"))).where(F.col("similarity") >= least).select(key, "ta", "tb", "similarity")
    a, b = sets.toDF(key, "ta", "_ba", "x"), sets.toDF(key, "tb", "_bb", "ys")
    pairs = near.join(a, [key, "ta"]).join(b, [key, "tb"]).where("ta < tb OR _ba <= _bb").repartition(tasks(rows))
    inside = (F.col("ta") == F.col("tb")) & (F.col("_ba") == F.col("_bb"))
    each = pairs.select(key, "similarity", inside.alias("_in"), "ys", F.explode("x").alias("x")).select(key, "similarity", "_in", "x", F.explode("ys").alias("y"))
    each = each.where("x < y OR (NOT _in AND x <> y)")
    return each.select(key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def matched_on_rounded(left: DataFrame, right: DataFrame, decimals: int = 1) -> DataFrame:
    """left, right (curve, x, y, seq): matched where x rounds alike; of duplicates the last counts."""

    def last(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("curve", "rx").orderBy(F.desc("seq"))
        return df.withColumn("rx", F.round("x", decimals)).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("curve", "rx", F.col("y").alias(name))

    return last(left, "left_y").join(last(right, "right_y"), ["curve", "rx"])


def cross_panel(panels: DataFrame, values: DataFrame) -> DataFrame:
    """Panels of one document drawn over different axes, each read at the other's fixed condition: their relative difference.

    panels (doc, panel, axis, fixed); values (doc, panel, at, value): a panel's curve where probed."""
    a, b = panels.select("doc", *[F.col(c).alias(f"a_{c}") for c in ("panel", "axis", "fixed")]), panels.select("doc", *[F.col(c).alias(f"b_{c}") for c in ("panel", "axis", "fixed")])
    pair = a.join(b, "doc").where("a_axis < b_axis")
    va, vb = values.toDF("doc", "a_panel", "b_fixed", "a_value"), values.toDF("doc", "b_panel", "a_fixed", "b_value")
    j = pair.join(va, ["doc", "a_panel", "b_fixed"]).join(vb, ["doc", "b_panel", "a_fixed"])
    return j.select("doc", "a_panel", "b_panel", "a_value", "b_value", (F.col("a_value") / F.nullif("b_value", F.lit(0.0)) - 1).alias("err"))
