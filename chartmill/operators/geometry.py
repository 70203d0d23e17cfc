"""Strokes, frames, words side by side, tracked lines and exhaustive tick subsets.

Joins carry the page or panel as an equality, so pairs are formed within one page only. Grouped
functions hold one panel: their steps depend on the ones before them. Default arguments (distances, counts and
shares) are fixed values that results depend on.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import per_key
from .validate import yes


def line_frames(segments: DataFrame, merge: float = 1.0, least: int = 3, edge: float = 1.5) -> DataFrame:
    """segments (page, x0, y0, x1, y1) -> page, x0, y0, x1, y1, n_rows, n_cols: grids of `least` or more parallel rules each way.

    Rules with the same rounded span are one family; rules of a family within `merge` are one. A family of rows and one
    of columns make a frame where all four edges agree within `edge`."""

    def family(rules: DataFrame, lo: str, hi: str, at: str, n: str) -> DataFrame:
        w = Window.partitionBy("page", "_lo", "_hi").orderBy("_at")
        r = rules.select("page", F.round(lo).alias("_lo"), F.round(hi).alias("_hi"), F.col(at).alias("_at"))
        r = r.withColumn("_new", F.coalesce(F.col("_at") - F.lag("_at").over(w) > merge, F.lit(True)))
        return r.groupBy("page", "_lo", "_hi").agg(F.count_if("_new").alias(n), F.min("_at").alias("_first"), F.max("_at").alias("_last")).where(F.col(n) >= least)

    flat = segments.where("abs(y1 - y0) <= 0.5 AND abs(x1 - x0) > 0.5").withColumn("lo", F.least("x0", "x1")).withColumn("hi", F.greatest("x0", "x1"))
    tall = segments.where("abs(x1 - x0) <= 0.5 AND abs(y1 - y0) > 0.5").withColumn("lo", F.least("y0", "y1")).withColumn("hi", F.greatest("y0", "y1"))
    rows = family(flat, "lo", "hi", "y0", "n_rows").toDF("page", "x0", "x1", "n_rows", "top", "bottom")
    cols = family(tall, "lo", "hi", "x0", "n_cols").toDF("page", "y0", "y1", "n_cols", "left", "right")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= edge
    return rows.join(cols, "page").where(near("x0", "left") & near("x1", "right") & near("y0", "top") & near("y1", "bottom")).select("page", "x0", "y0", "x1", "y1", "n_rows", "n_cols")


def stroke_joins(strokes: DataFrame, most: float) -> DataFrame:
    """strokes (panel, id, x0, y0, x1, y1): an end joins a start within `most` only if neither has another choice."""
    a, b = strokes.select("panel", F.col("id").alias("tail"), F.col("x1").alias("ax"), F.col("y1").alias("ay")), strokes.select("panel", F.col("id").alias("head"), F.col("x0").alias("bx"), F.col("y0").alias("by"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    p = a.join(b, "panel").where("tail <> head").withColumn("distance", d).where(F.col("distance") <= most)
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy("panel", c)) == 1
    return p.withColumn("_a", alone("tail")).withColumn("_b", alone("head")).where("_a AND _b").select("panel", "tail", "head", "distance")


def connected_strokes(strokes: DataFrame, most: float = 1.5) -> DataFrame:
    """strokes (panel, id, x0, y0, x1, y1) -> panel, id, component: ends within the true distance `most`, followed through."""

    def run(panel, c: dict[str, np.ndarray]) -> list[tuple]:
        ids = c["id"].tolist()
        ends = np.stack([np.stack([c["x0"], c["y0"]], 1), np.stack([c["x1"], c["y1"]], 1)], 1).astype(float)
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(ids) - 1):
            near = np.sqrt(((ends[i][:, None, None, :] - ends[None, i + 1 :]) ** 2).sum(-1)).min((0, 2)) <= most
            for j in np.flatnonzero(near).tolist():
                a, b = find(i), find(j + i + 1)
                root[max(a, b)] = min(a, b)
        return [(panel, ids[i], ids[find(i)]) for i in range(len(ids))]

    return per_key(strokes, "panel", ["id", "x0", "y0", "x1", "y1"], run, "panel long, id long, component long", ("id",))


def side_by_side(words: DataFrame, low: float = -0.75, high: float = 5.0, rise: float = 2.0) -> DataFrame:
    """words (page, id, text, x0, x1, cy): pairs where one follows the other at low..high points on one row, each having no other such neighbour."""
    a, b = words.select("page", F.col("id").alias("left"), F.col("text").alias("lt"), F.col("x1").alias("ax"), F.col("cy").alias("ay")), words.select("page", F.col("id").alias("right"), F.col("text").alias("rt"), F.col("x0").alias("bx"), F.col("cy").alias("by"))
    p = a.join(b, "page").where(F.col("left") != F.col("right")).where((F.col("bx") - F.col("ax")).between(low, high) & (F.abs(F.col("ay") - F.col("by")) <= rise))
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy("page", c)) == 1
    return p.withColumn("_a", alone("left")).withColumn("_b", alone("right")).where("_a AND _b").select("page", "left", "right", F.concat("lt", "rt").alias("text"))


def track(centres: DataFrame, step: float = 24.0, misses: int = 80) -> DataFrame:
    """centres (panel, x, y): a line followed rightwards from the topmost first centre, by the nearest centre to a straight prediction."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by_x = {x: sorted(g["y"]) for x, g in pdf.groupby("x")}
        xs = sorted(by_x)
        path, missed = [(xs[0], by_x[xs[0]][0])], 0
        for x in xs[1:]:
            slope = (path[-1][1] - path[-2][1]) / (path[-1][0] - path[-2][0]) if len(path) > 1 else 0.0
            want = path[-1][1] + slope * (x - path[-1][0])
            y = min(by_x[x], key=lambda v: (abs(v - want), v))
            if abs(y - want) <= step:
                path.append((x, y))
                missed = 0
            else:
                missed += 1
                if missed > misses:
                    break
        return pd.DataFrame([(pdf["panel"].iloc[0], x, y) for x, y in path], columns=["panel", "x", "y"])

    return centres.groupBy("panel").applyInPandas(run, "panel long, x double, y double")


def trusted_subset(ticks: DataFrame, residual: float = 1.0, least: int = 4, most: int = 12) -> DataFrame:
    """ticks (axis, pixel, value) -> axis, n, m, b, status: the largest subset on one line, refused unless all such subsets give one model.

    Subsets grow as 2^n: axes of more than `most` ticks have a status of their own."""

    def run(axis, cols: dict[str, np.ndarray]) -> list[tuple]:
        p, v = cols["pixel"].astype(float), cols["value"].astype(float)
        if len(p) > most:
            return [(axis, 0, None, None, "too_many_ticks")]
        for size in range(len(p), least - 1, -1):
            sets = np.array(list(itertools.combinations(range(len(p)), size)))
            x, y = p[sets], v[sets]
            mx, my = x.mean(1, keepdims=True), y.mean(1, keepdims=True)
            xx = ((x - mx) ** 2).sum(1)
            some = xx > 0
            m = np.where(some, ((x - mx) * (y - my)).sum(1) / np.where(some, xx, 1), 0.0)
            b = my[:, 0] - m * mx[:, 0]
            slope = np.where(np.abs(m) > 1e-12, m, 1.0)
            off = np.sqrt(np.mean(((y - b[:, None]) / slope[:, None] - x) ** 2, axis=1))
            good = some & (np.abs(m) > 1e-12) & (off <= residual)
            models = sorted({(round(float(i), 6) + 0.0, round(float(j), 4) + 0.0) for i, j in zip(m[good], b[good], strict=True)})
            if models:
                one = len(models) == 1
                return [(axis, size, models[0][0] if one else None, models[0][1] if one else None, "ok" if one else "ambiguous")]
        return [(axis, 0, None, None, "no_subset")]

    return per_key(ticks, "axis", ["pixel", "value"], run, "axis long, n long, m double, b double, status string", ("pixel", "value"))


def same_curve(points: DataFrame, pairs: DataFrame, common: float = 0.90, mean: float = 1.0, tail: float = 2.0) -> DataFrame:
    """pairs (left, right) of curves (curve, x, y): one curve if 90 % of x is common and y differs little; the 95th percentile is a sorted element."""
    a = pairs.join(points.toDF("left", "x", "ly"), "left")
    b = pairs.join(points.toDF("right", "x", "ry"), "right")
    j = a.join(b, ["left", "right", "x"], "full").withColumn("_d", F.abs(F.col("ly") - F.col("ry")))
    g = j.groupBy("left", "right").agg((F.count("_d") / F.count(F.lit(1))).alias("share"), F.avg("_d").alias("mean_difference"), F.array_sort(F.collect_list("_d")).alias("_all"))
    p95 = F.get("_all", F.least(F.size("_all") - 1, F.floor(0.95 * F.size("_all")).cast("int")))
    g = g.withColumn("p95", p95)
    return g.select("left", "right", "share", "mean_difference", "p95", yes((F.col("share") >= common) & (F.col("mean_difference") <= mean) & (F.col("p95") <= tail)).alias("same"))


def exchanged_below(points: DataFrame, split: Column, one: str, two: str) -> DataFrame:
    """points (curve, trace, x, y): the names of two traces change places where x is below split."""
    t = F.when((F.col("x") < split) & (F.col("trace") == one), two).when((F.col("x") < split) & (F.col("trace") == two), one).otherwise(F.col("trace"))
    return points.withColumn("trace", t)


def grid_regions(rules: DataFrame, least: int = 4, height: float = 60.0, slack: float = 6.0) -> DataFrame:
    """rules (page, id, x0, x1, y), horizontal: in order of y each joins the first group whose ends agree; groups of 4 rules and 60 points are regions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list] = []
        for r in pdf.sort_values(["y", "id"]).itertuples():
            g = next((g for g in groups if abs(g[0].x0 - r.x0) <= slack and abs(g[0].x1 - r.x1) <= slack), None)
            if g is None:
                groups.append([r])
            else:
                g.append(r)
        rows = [(g[0].page, min(r.x0 for r in g), g[0].y, max(r.x1 for r in g), g[-1].y, len(g)) for g in groups if len(g) >= least and g[-1].y - g[0].y >= height]
        return pd.DataFrame(rows, columns=["page", "x0", "y0", "x1", "y1", "n_rules"])

    return rules.groupBy("page").applyInPandas(run, "page long, x0 double, y0 double, x1 double, y1 double, n_rules long")


def vendor_tail(first_v: Column, vint: Column, tail_at_first: Column, total: Column, span: tuple[Column, Column], chart: Column, reference: Column, tolerance: float = 0.25) -> Column:
    """A vendor's own charge curve replaces what lies below the chart: null without one, out_of_range, pass or fail."""
    lo, hi = span
    inside = first_v.between(lo, hi) & vint.between(lo, hi)
    ref = F.coalesce(reference, total)
    off = F.abs(chart + tail_at_first - ref) / F.nullif(ref, F.lit(0.0))
    return F.when(vint.isNull() | total.isNull(), F.lit(None).cast("string")).when(~yes(inside), "out_of_range").when(yes(off <= tolerance), "pass").otherwise("fail")


def two_curve_order(grid: DataFrame, margin: float, least: int = 5) -> DataFrame:
    """grid (pair, i, left_value, right_value), left cold and right hot: robust runs of sign of hot - cold may be -, -+ or + only."""
    from .curves import robust_sequence

    p = grid.select(F.col("pair").alias("curve"), F.col("i").cast("double").alias("x"), (F.col("right_value") - F.col("left_value")).alias("y"))
    s = robust_sequence(p, margin, least)
    ok = F.col("signs").isin("-1", "-1,1", "1")
    return s.select(F.col("curve").alias("pair"), "signs", F.when(~ok, "contradictory").when(F.col("signs") == "-1", "ordered").otherwise("crossover").alias("status"))


def export_verdicts(traces: DataFrame, most_offset_pf: float = 15.0) -> DataFrame:
    """traces (panel, trace, n, reasons, anchor_pf, sampled_pf) -> pass, absent or rejected by trace, each on its own evidence.

    A tiny Crss anchor allows an additive correction instead of a rejection."""
    off = F.col("anchor_pf") - F.col("sampled_pf")
    far = F.abs(off) / F.nullif("anchor_pf", F.lit(0.0)) > 0.25
    tiny = yes((F.col("trace") == "Crss") & (F.col("anchor_pf") <= most_offset_pf))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "absent").when(F.size("reasons") > 0, "rejected").when(yes(far) & ~tiny, "rejected").otherwise("pass")
    return traces.select("panel", "trace", status.alias("status"), F.when((status == "pass") & tiny & yes(far), off).otherwise(F.lit(0.0)).alias("offset_pf"))
