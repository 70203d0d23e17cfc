"""Aggregates and grouped fits: argbest with explicit order, refusals, law fits, fingerprints, medoids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an explicit order: what ties do is in the order, never left to chance."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def exactly_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The only distinct value of a key, if it is positive; otherwise null and the reason."""
    g = rows.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"))
    reason = F.when(F.col("_n") == 0, "missing").when(F.col("_n") > 1, "conflicting").when(F.col("_v") <= 0, "not_positive")
    return g.select(key, F.when(reason.isNull(), F.col("_v")).alias("value"), reason.alias("reason"))


def inherit_in_blocks(rows: DataFrame, gap: int = 2) -> DataFrame:
    """rows (part, line, unit, condition): contiguous lines (steps of `gap` at most) share the block's only unit and condition."""
    w = Window.partitionBy("part").orderBy("line")
    b = rows.withColumn("block", F.sum(F.when(F.col("line") - F.lag("line").over(w) > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    g = b.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("unit").alias("_u"), F.min("unit").alias("_unit"), F.count_distinct("condition").alias("_c"), F.min("condition").alias("_cond"), F.min("line").alias("first_line"))
    status = F.when(F.col("_c") > 1, "conflicting_condition").when(F.col("_u") > 1, "mixed_units").when((F.col("_c") == 0) | (F.col("_u") == 0), "incomplete").otherwise("ok")
    out = g.withColumn("status", status)
    return out.select("part", "block", "first_line", "n_rows", F.when(F.col("status") == "ok", F.col("_unit")).alias("unit"), F.when(F.col("status") == "ok", F.col("_cond")).alias("condition"), "status")


def square_law(points: DataFrame) -> DataFrame:
    """I = K (V - Vth)^2 fitted as sqrt(I) = sqrt(K) (V - Vth) over positive currents: curve, k, vth, n."""
    good = points.where("i > 0")
    g = good.groupBy("curve").agg(F.regr_slope(F.sqrt("i"), F.col("v")).alias("_s"), F.regr_intercept(F.sqrt("i"), F.col("v")).alias("_b"), F.count(F.lit(1)).alias("n"))
    return g.select("curve", (F.col("_s") * F.col("_s")).alias("k"), (-F.col("_b") / F.nullif("_s", F.lit(0.0))).alias("vth"), "n")


def pivot_vth(points: DataFrame, pivots: DataFrame, p: float = 2.0, samples: int = 160, steps: int = 80) -> DataFrame:
    """points (curve, v, i), pivots (curve, vpl, id_pl) -> curve, status, vth, k, rms, i_lo, i_hi: I = K (V - Vth)^p held exactly at the pivot.

    The error is of gate voltage, at `samples` matched currents of a window; a golden section finds Vth. Curves of fewer than 8
    positive currents, and windows too short to tell, are refused by status."""
    from .interpolate import interp_clamped

    good = points.where("i > 0").groupBy("curve", F.col("i").alias("x")).agg(F.max("v").alias("y"))
    size = good.groupBy("curve").agg(F.count(F.lit(1)).alias("_n"))
    top = points.groupBy("curve").agg(F.max("i").alias("_top")).join(size, "curve", "left")
    # Bounds of the window in shares of the pivot's and of the greatest current
    w = pivots.join(top, "curve").withColumn("i_lo", F.greatest(0.05 * F.col("id_pl"), 0.02 * F.col("_top"))).withColumn("i_hi", F.least(2.0 * F.col("id_pl"), 0.85 * F.col("_top")))
    w = w.withColumn("status", F.when(F.coalesce(F.col("i_hi") <= 1.5 * F.col("i_lo"), F.lit(True)), "short_current_span").when(F.coalesce("_n", F.lit(0)) < 8, "too_few_points").otherwise("ok"))
    grid = w.where("status = 'ok'").select("curve", "vpl", "id_pl", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_k"), "i_lo", "i_hi")
    probes = grid.select("curve", "vpl", "id_pl", (F.col("i_lo") + (F.col("i_hi") - F.col("i_lo")) * F.col("_k") / (samples - 1)).alias("px"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, v = pdf["px"].to_numpy(float), pdf["value"].to_numpy(float)
        vpl, pivot = float(pdf["vpl"].iloc[0]), float(pdf["id_pl"].iloc[0])
        scale = lambda t: pivot / (vpl - t) ** p
        rms = lambda t: float(np.sqrt(np.mean((t + (i / scale(t)) ** (1 / p) - v) ** 2)))
        a, b, g = 0.05 * vpl, 0.95 * vpl, (5**0.5 - 1) / 2
        for _ in range(steps):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if rms(c) < rms(d) else (c, b)
        t = (a + b) / 2
        return pd.DataFrame({"curve": [pdf["curve"].iloc[0]], "vth": [t], "k": [scale(t)], "rms": [rms(t)]})

    fit = interp_clamped(good, probes).groupBy("curve").applyInPandas(run, "curve long, vth double, k double, rms double")
    return w.join(fit, "curve", "left").select("curve", "status", "vth", "k", "rms", "i_lo", "i_hi")


def fit_depletion(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """c0, phi, m of c0 / (1 + x / phi)^m through the first point, phi in 0.3..3 and m in 0.3..0.6, by projected Gauss-Newton."""
    first_x, first_y = float(x[0]), float(y[0])
    phi, m = 1.0, 0.5

    def model(phi: float, m: float) -> np.ndarray:
        return first_y * ((1 + first_x / phi) / (1 + x / phi)) ** m

    if len(x) >= 3:
        lam, best = 1e-3, float(((model(phi, m) - y) ** 2).sum())
        for _ in range(200):
            f = model(phi, m)
            d_m = f * np.log((1 + first_x / phi) / (1 + x / phi))
            d_phi = f * m * (x / (phi * phi) / (1 + x / phi) - first_x / (phi * phi) / (1 + first_x / phi))
            j = np.stack([d_phi, d_m], 1)
            h = j.T @ j
            step = np.linalg.lstsq(h + lam * np.diag(np.diag(h) + 1e-12), j.T @ (y - f), rcond=None)[0]
            new = float(np.clip(phi + step[0], 0.3, 3.0)), float(np.clip(m + step[1], 0.3, 0.6))
            e = float(((model(*new) - y) ** 2).sum())
            if e < best:
                done = best - e <= 1e-14 * best
                (phi, m), best, lam = new, e, lam / 3
                if done:
                    break
            else:
                lam *= 4
                if lam > 1e12:
                    break
    return first_y * (1 + first_x / phi) ** m, phi, m


def coss_metrics(points: DataFrame, vint: float, samples: int = 4000, ceiling: float | None = None, tolerance: float = 0.02) -> DataFrame:
    """Charge and energy of cleaned points (curve, x, y) from 0 to vint: depletion law below the first point, interpolation above.

    With a ceiling, a leading run of clipped points is completed by the law, never below what is drawn."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        clear = 0
        if ceiling:
            over = y >= ceiling * (1 - tolerance)
            clear = int(np.argmin(over)) if over[0] and not over.all() else 0
            clear = clear if 0 < clear < len(y) - 2 else 0
        fx, fy = x[clear:], y[clear:]
        # The fit takes points up to ten times the first voltage or the seventh point, six of them if that leaves too few
        edge = max(fx[0] * 10, fx[min(len(fx) - 1, 6)]) if fx[0] > 0 else fx[min(len(fx) - 1, 6)]
        low = fx <= edge
        if low.sum() < 3:
            low[:6] = True
        c0, phi, m = fit_depletion(fx[low], fy[low])
        g = np.linspace(0, vint, samples)
        c = np.where(g < fx[0], c0 / (1 + g / phi) ** m, np.interp(g, fx, fy))
        if clear:
            c = np.where(g < fx[0], np.maximum(c, np.interp(g, x, y)), c)
        step = np.diff(g)
        dq, de = (c[1:] + c[:-1]) / 2 * step, (c[1:] * g[1:] + c[:-1] * g[:-1]) / 2 * step
        mid = (g[1:] + g[:-1]) / 2
        q, e = float(dq.sum()), float(de.sum())
        below = float(dq[mid < x[0]].sum())
        row = (pdf["curve"].iloc[0], q, e, q / vint, 2 * e / vint**2, below, float(dq[(mid >= x[0]) & (mid <= x[-1])].sum()), float(dq[mid > x[-1]].sum()), phi, m, below / q if q > 0 else 0.0, bool(clear))
        return pd.DataFrame([row], columns=["curve", "qoss", "eoss", "co_tr", "co_er", "q_below", "q_chart", "q_above", "phi", "m", "extrapolated_fraction", "clipped"])

    return points.groupBy("curve").applyInPandas(run, "curve long, qoss double, eoss double, co_tr double, co_er double, q_below double, q_chart double, q_above double, phi double, m double, extrapolated_fraction double, clipped boolean")


def fingerprint(tokens: Column) -> Column:
    """20 hex digits of a token set."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(tokens)), "\n"), 256), 1, 20)


def medoids(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, id, tokens): of one or two members the smallest id; else the greatest summed similarity, then fewest tokens, then greatest id.

    Sets are compared once each, weighed by the rows that hold them."""
    from .match import dealt, jaccard

    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    held = rows.select(key, F.col("id").alias("a"), F.size("tokens").alias("size"), F.array_sort(F.array_distinct("tokens")).alias("t"))
    sets = held.groupBy(key, "t").agg(F.count(F.lit(1)).alias("_n"))
    both = dealt(sets.select(key, F.col("t").alias("ta")), sets.select(key, F.col("t").alias("tb"), "_n"), key)
    total = both.groupBy(key, F.col("ta").alias("t")).agg(F.sum(F.col("_n") * jaccard(F.col("ta"), F.col("tb"))).alias("total"))
    s = held.join(total, [key, "t"], "left").groupBy(key, "a").agg(F.round(F.sum("total"), 9).alias("total"), F.max("size").alias("size"))
    best = best_row(s, [key], F.desc("total"), F.asc("size"), F.desc("a")).select(key, "a")
    return n.join(best, key).select(key, "n", F.when(F.col("n") <= 2, F.col("least")).otherwise(F.col("a")).alias("medoid"))


def verdicts(gates: DataFrame) -> DataFrame:
    """gates (entity, seq, gate, passed, reason) -> accepted only if every gate is known to have passed; reasons in order, once each."""
    ok = F.coalesce("passed", F.lit(False))
    g = gates.groupBy("entity").agg(F.count(F.lit(1)).alias("n_gates"), F.count_if(ok).alias("n_passed"), F.array_sort(F.collect_list(F.when(~ok, F.struct("seq", F.coalesce("reason", F.concat(F.col("gate"), F.lit("_unevaluated"))).alias("reason"))))).alias("_r"))
    reasons = F.array_distinct(F.transform("_r", lambda r: r["reason"]))
    return g.select("entity", "n_gates", "n_passed", F.when(F.col("n_passed") == F.col("n_gates"), "accepted").otherwise("rejected").alias("status"), F.array_join(reasons, ",").alias("reasons"))


def regression_summary(rows: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by (method, source, status), and the parts whose status isn't as expected in either direction."""
    counts = rows.groupBy("method", "source", "status").agg(F.count(F.lit(1)).alias("n"))
    got, want = rows.select("part", "status"), expected.select("part", "status")
    return counts, got.exceptAll(want).withColumn("side", F.lit("unexpected")).unionByName(want.exceptAll(got).withColumn("side", F.lit("missing")))
