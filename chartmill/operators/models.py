"""Charge models, trace identity, temperature laws and layout clustering: the grouped algorithms."""

from __future__ import annotations

import itertools
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from .grouped import per_key
from .interpolate import interp_clamped
from .validate import TRACES


def adaptive_knots(points: DataFrame, most_error: float = 0.02, most_knots: int = 256) -> DataFrame:
    """Cleaned points -> knots (curve, knot, x, y, achieved): the ends first, then the worst sample of the log-space interpolation until it is good enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        scale = max((x[-1] - x[0]) * 0.01, 1e-6)
        z, c = np.log1p(np.maximum(x, 0) / scale), np.log10(y)
        used = np.zeros(len(x), dtype=bool)
        used[[0, -1]] = True
        while True:
            off = np.abs(10 ** (np.interp(z, z[used], c[used]) - c) - 1)
            if off.max() <= most_error or used.sum() >= min(most_knots, len(x)):
                break
            used[int(off.argmax())] = True
        k = np.flatnonzero(used)
        return pd.DataFrame({"curve": pdf["curve"].iloc[0], "knot": np.arange(len(k)), "x": x[k], "y": y[k], "scale": scale, "achieved": float(off.max())})

    return points.groupBy("curve").applyInPandas(run, "curve long, knot long, x double, y double, scale double, achieved double")


def charge_table(knots: DataFrame, v_max: float, samples: int = 256) -> DataFrame:
    """knots -> curve, i, v, c, q, e on a log grid from 0 to v_max: clamped log-space interpolation, then running trapezoids."""
    scale = knots.groupBy("curve").agg(F.first("scale").alias("scale"))
    z = N.log_scale(F.lit(float(v_max)), F.col("scale")) * F.col("i") / (samples - 1)
    grid = scale.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("px", z)
    logk = knots.select("curve", N.log_scale(F.col("x"), F.col("scale")).alias("x"), F.log10("y").alias("y"))
    t = interp_clamped(logk, grid.select("curve", "px", "i", "scale")).withColumn("v", N.from_log_scale(F.col("px"), F.col("scale"))).withColumn("c", F.pow(F.lit(10.0), F.col("value")))
    w = Window.partitionBy("curve").orderBy("i")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    dv = F.col("v") - F.lag("v").over(w)
    t = t.withColumn("_q", F.coalesce(0.5 * (F.col("c") + F.lag("c").over(w)) * dv, F.lit(0.0))).withColumn("_e", F.coalesce(0.5 * (F.col("c") * F.col("v") + F.lag("c").over(w) * F.lag("v").over(w)) * dv, F.lit(0.0)))
    return t.select("curve", "i", "v", "c", F.sum("_q").over(up).alias("q"), F.sum("_e").over(up).alias("e"))


def _short(c: str):
    """Nine significant digits without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9g", c), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def spice_text(table: DataFrame) -> DataFrame:
    """curve, netlist: a tabulated charge function and the current source that differentiates it. Charges are pC in, coulombs out."""
    pair = F.struct("i", F.concat(_short("v"), F.lit(","), F.format_string("%.9e", F.col("q") * 1e-12)).alias("t"))
    rows = table.groupBy("curve").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), ", ").alias("body"))
    name = F.concat(F.lit("c"), F.col("curve").cast("string"))
    text = F.concat(F.lit(".func qoss_"), name, F.lit("(v) {table(max(v,0), "), F.col("body"), F.lit(")}\nB_COSS_"), name, F.lit(" d s I=ddt(qoss_"), name, F.lit("(V(d,s)))\n"))
    return rows.select("curve", text.alias("netlist"))


def assign_traces(residuals: DataFrame, priors: DataFrame) -> DataFrame:
    """Which drawn trace is which quantity: all six assignments scored against table anchors and shape priors.

    residuals (panel, trace, quantity, log_ratio): a trace read at a quantity's anchor, null where it can't be; rows for anchors that exist.
    priors (panel, assignment, prior): assignment is the traces that play Ciss, Coss, Crss, joined by commas.
    A change from the drawn names needs two anchors, a gain of 0.12 decades, an RMS of 0.18 and no residual over 0.25."""
    spark = residuals.sparkSession
    perms = [(",".join(p), q, t) for p in itertools.permutations(TRACES) for q, t in zip(TRACES, p, strict=True)]
    table = spark.createDataFrame(perms, "assignment string, quantity string, trace string")  # 18 rows
    s = residuals.join(F.broadcast(table), ["quantity", "trace"]).groupBy("panel", "assignment").agg(F.count("log_ratio").alias("n"), (F.count(F.lit(1)) - F.count("log_ratio")).alias("missing"), F.sqrt(F.avg(F.col("log_ratio") * F.col("log_ratio"))).alias("rms"), F.max(F.abs("log_ratio")).alias("worst"))
    s = s.join(priors, ["panel", "assignment"], "left").withColumn("score", F.coalesce("rms", F.lit(0.0)) + 0.5 * F.col("missing") + F.coalesce("prior", F.lit(0.0)))
    base = s.where(F.col("assignment") == ",".join(TRACES)).select("panel", F.col("score").alias("base_score"))
    order = Window.partitionBy("panel").orderBy(F.round("score", 9), F.when(F.col("assignment") == ",".join(TRACES), 0).otherwise(1), "assignment")
    best = s.withColumn("_r", F.row_number().over(order)).where("_r = 1").join(base, "panel")
    gain = F.col("base_score") - F.col("score")
    reason = F.when(F.col("assignment") == ",".join(TRACES), "baseline_best").when(F.col("n") < 2, "insufficient_anchor_coverage").when(gain < 0.12, "improvement_too_small").when(F.col("rms") > 0.18, "best_anchor_fit_too_poor").when(F.col("worst") > 0.25, "anchor_outlier_prevents_relabel").otherwise("anchor_evidence_selected")
    out = best.withColumn("reason", reason)
    return out.select("panel", "reason", F.when(F.col("reason") == "anchor_evidence_selected", F.col("assignment")).otherwise(",".join(TRACES)).alias("assignment"), "score", "base_score", "n")


def temperature_law(curves: DataFrame, anchors: DataFrame, samples: int = 120) -> DataFrame:
    """Shift of the gate voltage between two temperatures at matched currents, fitted by dV = dVth + s * (I / K)^(1/p).

    curves (part, temp, i, v) with strictly increasing i in a curve; anchors (part, tref, vth, k, p, id_gc, vpl). Statuses say what is missing.
    A part's anchor and points meet in one shuffle and are fitted together; points without temp, i or v are left out."""
    kind = anchors.schema["part"].dataType.simpleString()
    names = ["tref", "vth", "k", "p", "id_gc", "vpl"]

    def fitted(anchor: list, temp: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        tref, vth, k, p, id_gc, vpl = (np.nan if a is None else float(a) for a in anchor)
        cold, hot = temp[np.abs(temp - tref) <= 1e-6], temp[temp > tref + 1e-6]
        if not len(cold):
            return ("no_reference_curve", *[None] * 5)
        if not len(hot):
            return ("no_hotter_curve", *[None] * 5)
        if not (k > 0 and p > 1 and id_gc > 0 and vpl > vth):
            return ("nonphysical_anchor", *[None] * 5)
        if abs(k * (vpl - vth) ** p - id_gc) / id_gc > 1e-6:
            return ("anchor_off_pivot", *[None] * 5)
        a, b = temp == cold[0], temp == hot.max()
        lo, hi = max(5.0, 0.10 * id_gc), min(2.0 * id_gc, 0.85 * min(x[a].max(), x[b].max()))
        if hi <= 2 * lo:
            return ("short_current_span", *[None] * 5)
        at = lo + (hi - lo) * np.arange(samples) / (samples - 1)
        vc, ov = np.interp(at, x[a], y[a]), (at / k) ** (1 / p)
        d = np.interp(at, x[b], y[b]) - vc
        do, dd = ov - ov.mean(), d - d.mean()
        xx, xy, yy = float(do @ do), float(do @ dd), float(dd @ dd)
        s = xy / xx
        vs = float(d.mean() - s * ov.mean())
        rms, off = float(np.sqrt(max(yy - xy * xy / xx, 0.0) / samples)), vth + ov - vc
        cold_rms = float(np.sqrt(np.mean(off * off)))
        if 1 + s <= 0:
            return ("nonpositive_scale", None, None, rms, cold_rms, None)
        if rms > 0.1:
            return ("law_misses_shifts", None, None, rms, cold_rms, None)
        dt = float(hot.max() - cold[0])
        return ("ok", vs / dt, float(-p * np.log(1 + s) / dt), rms, cold_rms, k * (-vs / s) ** p if s and -vs / s > 0 else None)

    def run(part, c: dict[str, np.ndarray]) -> list[tuple]:
        own = c["anchor"]
        n = next((i for i, a in enumerate(own) if a is None), len(own))  # anchors come first
        return [(part, *fitted(list(a), c["temp"][n:], c["i"][n:], c["v"][n:])) for a in own[:n]]

    pts = curves.where("part IS NOT NULL").select("part", *[F.col(c).cast("double").alias(c) for c in ("temp", "i", "v")], F.lit(None).cast("array<double>").alias("anchor"))
    nothing = F.lit(None).cast("double")
    own = anchors.select("part", *[nothing.alias(c) for c in ("temp", "i", "v")], F.array(*[F.col(c).cast("double") for c in names]).alias("anchor"))
    rows = own.unionByName(pts.where("temp IS NOT NULL AND i IS NOT NULL AND v IS NOT NULL"))
    return per_key(rows, "part", ["temp", "i", "v", "anchor"], run, f"part {kind}, status string, d_vth_per_k double, d_log_k_per_k double, rms double, cold_rms double, ztc_a double", ("temp", "i"))


def cluster_layouts(pages: DataFrame, threshold: float = 0.72) -> DataFrame:
    """pages (coarse, id, fingerprint, tokens) -> id, coarse, cluster, medoid: greedy clustering behind the coarse key.

    Candidates never leave their coarse key. Pages of one fingerprint are one row with their number and their least and
    greatest id before a key is clustered, so a task holds distinct layouts, not pages; a medoid is found over these."""

    def similarity(a: frozenset, b: frozenset) -> float:
        return len(a & b) / len(a | b) if a or b else 1.0

    def centre(groups: list[tuple]) -> tuple[frozenset, str]:
        if sum(n for _, n, _, _ in groups) <= 2:
            low, tokens = min((low, tokens) for tokens, _, low, _ in groups)
            return tokens, low
        top = max(((sum(n * similarity(t, u) for u, n, _, _ in groups), -len(t), high, t) for t, _, _, high in groups), key=lambda x: x[:3])
        return top[3], top[2]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = {f: (frozenset(t), int(n), low, high) for f, t, n, low, high in zip(pdf["fingerprint"], pdf["tokens"], pdf["n"], pdf["low"], pdf["high"], strict=True)}
        made: list[list] = []
        for f, g in sorted(groups.items(), key=lambda x: (-x[1][1], x[1][2])):
            place, score = None, threshold
            for k, c in enumerate(made):
                s = similarity(g[0], c[1])
                if s >= score:
                    place, score = k, s
            if place is None:
                made.append([[], g[0], g[2], []])
            c = made[-1 if place is None else place]
            c[0].append(g)
            c[3].append(f)
            c[1], c[2] = centre(c[0])
        made.sort(key=lambda c: (-sum(n for _, n, _, _ in c[0]), c[2]))
        out = [(pdf["coarse"].iloc[0], f, k + 1, c[2]) for k, c in enumerate(made) for f in c[3]]
        return pd.DataFrame(out, columns=["coarse", "fingerprint", "cluster", "medoid"])

    layouts = pages.groupBy("coarse", "fingerprint").agg(F.min_by("tokens", "id").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    found = layouts.groupBy("coarse").applyInPandas(run, "coarse string, fingerprint string, cluster long, medoid string")
    return pages.select("id", "coarse", "fingerprint").join(found, ["coarse", "fingerprint"]).select("id", "coarse", "cluster", "medoid")


def document_signatures(pages: DataFrame) -> DataFrame:
    """pages (doc, page, role, mode, layout) -> doc, n_pages, tokens, fingerprint."""
    from .aggregate import fingerprint

    n = F.count(F.lit(1)).over(Window.partitionBy("doc"))
    p = pages.withColumn("_i", F.row_number().over(Window.partitionBy("doc").orderBy("page")) - 1).withColumn("_n", n)
    place = F.least(F.lit(4), F.floor(F.col("_i") * 5 / F.greatest("_n", F.lit(1)))).cast("string")
    rows = p.select("doc", F.explode(F.array_compact(F.array(F.concat(F.lit("pages:"), N.page_count_bin(F.col("_n"))), F.concat_ws(":", F.lit("page-role"), place, "role", "mode"), F.when(F.col("role") != "other", F.concat(F.lit("layout:"), "layout"))))).alias("t"))
    counts = [p.groupBy("doc", c).agg(F.count(F.lit(1)).alias("c")).select("doc", F.concat_ws(":", F.lit(f"{c}-count"), c, N.count_bin(F.col("c"))).alias("t")) for c in ("role", "mode")]
    all_ = rows.unionByName(counts[0]).unionByName(counts[1]).distinct()
    g = all_.groupBy("doc").agg(F.array_sort(F.collect_list("t")).alias("tokens"))
    size = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"))
    return g.join(size, "doc").select("doc", "n_pages", F.array_join("tokens", "\n").alias("tokens"), fingerprint(F.col("tokens")).alias("fingerprint"))


def chain_segments(segments: DataFrame, grid: float = 0.8) -> DataFrame:
    """segments (panel, seg, x0, y0, x1, y1) -> panel, seg, component: segments whose ends meet on a grid of `grid` points (panel-sized graphs)."""

    def run(panel, c: dict[str, np.ndarray]) -> list[tuple]:
        ends = np.rint(np.stack([c["x0"], c["y0"], c["x1"], c["y1"]], 1).astype(float) / grid).astype(np.int64).tolist()
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for e in ends:
            a, b = root((e[0], e[1])), root((e[2], e[3]))
            if a != b:
                parent[max(a, b)] = min(a, b)
        first: dict = {}
        roots = [root((e[0], e[1])) for e in ends]
        for r, s in zip(roots, c["seg"].tolist(), strict=True):  # segments come in order
            first.setdefault(r, s)
        return [(panel, s, first[r]) for r, s in zip(roots, c["seg"].tolist(), strict=True)]

    return per_key(segments, "panel", ["seg", "x0", "y0", "x1", "y1"], run, "panel long, seg long, component long", ("seg",))


def _running_percentile(y: np.ndarray, q: float) -> np.ndarray:
    """Percentile of the first k values, k = 1..n, interpolated linearly."""
    held: list[float] = []
    out = np.empty(len(y))
    for k, v in enumerate(y.tolist()):
        insort(held, v)
        at = q * k
        low = int(at)
        out[k] = held[low] + (held[min(low + 1, k)] - held[low]) * (at - low)
    return out


def _middle_level(x: np.ndarray, y: np.ndarray, left: float, width: float) -> float | None:
    """Mean of the middle one of three lines of least squared error; every line has n / 12 points and 8 at least."""
    n, least = len(x), max(8, len(x) // 12)
    if n < 30:
        return None
    rel = (x - left) / width
    u, v = x - x.mean(), y - y.mean()
    sums = [np.r_[0.0, np.cumsum(t)] for t in (np.ones(n), u, v, u * u, u * v, v * v)]

    def off(a, b):
        k, su, sv, suu, suv, svv = (t[b] - t[a] for t in sums)
        uu, uv = suu - su * su / k, suv - su * sv / k
        return np.maximum(svv - sv * sv / k - np.where(uu > 1e-9, uv * uv / np.where(uu > 1e-9, uu, 1.0), 0.0), 0.0)

    best = None
    for i in range(least, n - 2 * least):
        if 0.05 <= rel[i] <= 0.60:
            j = np.arange(i + least, n - least)
            j = j[(rel[j] >= 0.18) & (rel[j] <= 0.88)]
            if len(j):
                cost = np.round(off(0, i) + off(i, j) + off(j, n), 6)
                k = int(cost.argmin())
                if best is None or cost[k] < best[0]:
                    best = cost[k], i, int(j[k])
    return None if best is None else float(y[best[1] : best[2]].mean())


def plateau(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (curve, x, y) in pixels, y downwards, boxes (curve, x0, y0, x1, y1) -> curve, y_px, source: the level of a curve's flat stretch.

    Windows of 7 % of the points (8 at least) are scored by width over flatness, the lesser rise on either side, and how far left
    they are; of windows at 70 % of the best score the leftmost counts (source window). A loose one yields to the middle of three
    fitted lines, which also stands in where there is no window (source middle). Fewer than 20 points give nothing."""

    # Gates and weights
    first, last, rise, slack, lean, share, loose, apart = 0.04, 0.78, 0.05, 0.01, 8.0, 0.70, 0.010, 0.035

    def run(curve, c: dict[str, np.ndarray]) -> list[tuple]:
        x, y = c["x"].astype(float), c["y"].astype(float)
        x0, y0, x1, y1 = (float(c[k][0]) for k in ("x0", "y0", "x1", "y1"))
        n, width, height = len(x), max(1.0, x1 - x0), y1 - y0
        level = source = None
        if n >= 20:
            w = max(8, int(0.07 * n))
            i = np.arange(n - w)
            j = i + w
            inside = np.lib.stride_tricks.sliding_window_view(y, w)[: n - w]
            high, low, mid = np.percentile(inside, 90, axis=1), np.percentile(inside, 10, axis=1), np.median(inside, axis=1)
            rel = (0.5 * (x[i] + x[j - 1]) - x0) / width
            before = np.r_[np.nan, _running_percentile(y, 0.9)][i]
            after = np.r_[_running_percentile(y[::-1], 0.1)[::-1], np.nan][j]
            pre, post = before - mid, mid - after
            ok = (rel >= first) & (rel <= last) & (i >= 4) & (n - j >= 4) & (pre >= rise * height) & (post >= rise * height)
            score = 3.0 * (x[j - 1] - x[i]) / width / ((high - low) / max(1.0, height) + slack) + np.minimum(pre, post) / max(1.0, height) - lean * rel
            middle = _middle_level(x, y, x0, width)
            if ok.any():
                good = ok & (score >= share * score[ok].max())
                good = good if good.any() else ok
                k = np.flatnonzero(good)[rel[good].argmin()]
                level, source = float(mid[k]), "window"
                if middle is not None and high[k] - low[k] > loose * max(1.0, height) and abs(middle - level) > apart * max(1.0, height):
                    level, source = middle, "middle"
            elif middle is not None:
                level, source = middle, "middle"
        return [(curve, level, source)]

    return per_key(points.join(boxes, "curve"), "curve", ["x", "y", "x0", "y0", "x1", "y1"], run, "curve long, y_px double, source string", ("x", "y"))
