"""The closure audit of a batch of transfer records: twelve named gates, all of which must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .interpolate import interp_clamped
from .validate import known, yes

#: Gates in order.
GATES = ("artifacts-present", "overlay-footer-space", "visible-axis-and-legend-labels", "axis-metadata-complete", "plot-calibration-box", "curve-count-and-ids", "temperature-identity-consistent", "finite-calibrated-bounds", "curve-continuity", "trace-quality", "identity-provenance", "branch-independence")

# Words that an overlay shows, room under it, points of a curve, shares and slacks
SHOWN = ("X AXIS", "Y AXIS", "DIGITIZED", "VGS", "ID")
FOOTER, LEAST_POINTS, LEAST_SPAN, MOST_VIOLATIONS, MOST_COLLAPSE, MOST_SHARED, SAMPLES, TINY = 60, 20, 0.6, 0.02, 0.1, 0.05, 101, 1e-12


def _fine(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & known(F.col(c)).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    return out


def shared_runs(points: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """points (entity, curve, vgs, id) -> entity, shared: over pairs of curves, the longest run of samples of the common current span where both have the same voltage, as a share."""
    span = points.groupBy("entity", "curve").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    a, b = (span.toDF("entity", n, f"{n}_lo", f"{n}_hi") for n in ("a", "b"))
    pair = a.join(b, "entity").where("a < b").withColumn("lo", F.greatest("a_lo", "b_lo")).withColumn("hi", F.least("a_hi", "b_hi")).where("hi > lo")
    key = lambda c: F.concat_ws("|", F.col("entity").cast("string"), F.col(c).cast("string"))
    g = pair.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("px", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (samples - 1))
    curve = points.groupBy(key("curve").alias("curve"), F.col("id").alias("x")).agg(F.max("vgs").alias("y"))
    side = lambda c: interp_clamped(curve, g.select(key(c).alias("curve"), "px", "entity", "a", "b", "k")).select("entity", "a", "b", "k", F.col("value").alias(f"v_{c}"))
    both = side("a").join(side("b"), ["entity", "a", "b", "k"]).withColumn("same", F.abs(F.col("v_a") - F.col("v_b")) <= 1e-10)
    run = F.col("k") - F.sum(F.col("same").cast("long")).over(Window.partitionBy("entity", "a", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    n = both.withColumn("run", run).groupBy("entity", "a", "b", "run").agg(F.count_if("same").alias("n"))
    return n.groupBy("entity").agg((F.max("n") / samples).alias("shared"))


def closure_gates(records: DataFrame, points: DataFrame, identities: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """-> entity, seq, gate, passed, reason: rows for ``aggregate.verdicts``.

    records: entity, expected_curves, artifacts (boolean: source, overlay and points are there), source_w, source_h, overlay_w, overlay_h,
    overlay_text, x_quantity, x_unit, x_scale, x_min, x_max, y_quantity, y_unit, y_scale, y_min, y_max, px0, py0, px1, py1, labels
    (array), allowed_gap, provenance (boolean), vector (boolean: independent vector paths), collapse. points: entity, curve, i,
    temperature, vgs, id; identities: entity, curve, temperature; diagnostics: entity, curve, points, y_span, max_gap, violation.
    Curves are numbered from 1. What is missing fails."""
    c = F.col
    axis = (c("x_quantity") == "Vgs") & (c("x_unit") == "V") & (c("x_scale") == "linear") & (c("y_quantity") == "Id") & (c("y_unit") == "A") & c("y_scale").isin("linear", "log10") & _fine("x_min", "x_max", "y_min", "y_max") & (c("x_max") > c("x_min")) & (c("y_max") > c("y_min")) & ((c("y_scale") != "log10") | (c("y_min") > 0))
    plot = _fine("px0", "py0", "px1", "py1") & (c("px0") >= 0) & (c("px1") > c("px0")) & (c("px1") <= c("source_w")) & (c("py0") >= 0) & (c("py1") > c("py0")) & (c("py1") <= c("source_h"))
    text = F.regexp_replace(F.upper("overlay_text"), r"\s+", " ")
    shown = F.lit(True)
    for word in SHOWN:
        shown = shown & F.contains(text, F.lit(word))
    r = records.select("entity", "expected_curves", "labels", "allowed_gap", "x_min", "x_max", "y_min", "y_max", yes(c("artifacts")).alias("g0"), yes((c("overlay_w") == c("source_w")) & (c("overlay_h") >= c("source_h") + FOOTER)).alias("g1"), yes(shown).alias("g2"), yes(axis).alias("g3"), yes(plot).alias("g4"), ((c("x_max") - c("x_min")) / F.nullif(c("px1") - c("px0"), F.lit(0))).alias("pixel"), yes(c("provenance")).alias("g10"), yes(c("collapse").between(0, 1) & ((c("collapse") <= MOST_COLLAPSE) | c("vector"))).alias("independent"))
    w = Window.partitionBy("entity", "curve").orderBy("i")
    p = points.join(r.select("entity", "x_min", "x_max", "y_min", "y_max", "pixel"), "entity")
    inside = _fine("temperature", "vgs", "id") & c("vgs").between(c("x_min") - c("pixel"), c("x_max") + c("pixel")) & c("id").between(c("y_min") - TINY, c("y_max") + TINY)
    p = p.withColumns({"inside": yes(inside), "back_i": F.lag("id").over(w) - c("id"), "back_v": F.lag("vgs").over(w) - c("vgs")})
    per = p.groupBy("entity", "curve").agg(F.count(F.lit(1)).alias("n"), F.min("inside").alias("inside"), F.coalesce(F.max("back_i"), F.lit(0.0)).alias("back_i"), F.coalesce(F.max("back_v"), F.lit(0.0)).alias("back_v"), F.max("pixel").alias("pixel"), F.min("temperature").alias("t_min"), F.max("temperature").alias("t_max"))
    smooth = (c("n") >= LEAST_POINTS) & (c("back_i") <= TINY) & (c("back_v") <= 1.1 * c("pixel") + TINY)
    full = per.join(identities.withColumnRenamed("temperature", "said"), ["entity", "curve"], "full").join(diagnostics, ["entity", "curve"], "full")
    agreed = yes((c("t_min") == c("said")) & (c("t_max") == c("said")))
    sound = _fine("y_span", "max_gap", "violation") & c("y_span").between(LEAST_SPAN, 1) & c("max_gap").between(0, 1) & c("violation").between(0, MOST_VIOLATIONS) & (c("points") == c("n"))
    full = full.join(r.select("entity", "allowed_gap"), "entity", "left")
    e = full.groupBy("entity").agg(
        F.array_sort(F.collect_set(F.when(c("n").isNotNull(), c("curve")))).alias("drawn"), F.array_sort(F.collect_set(F.when(c("said").isNotNull(), c("curve")))).alias("named"), F.array_sort(F.collect_set("said")).alias("temps"), F.array_sort(F.collect_set(F.when(c("points").isNotNull(), c("curve")))).alias("checked"),
        F.min(F.when(c("n").isNotNull(), yes((c("n") >= LEAST_POINTS) & c("inside")))).alias("bounded"), F.min(F.when(c("n").isNotNull(), yes(smooth))).alias("smooth"), F.min(agreed).alias("agreed"), F.min(F.when(c("points").isNotNull(), yes(sound & (c("max_gap") <= c("allowed_gap") + TINY)))).alias("sound"),
    )
    s = r.join(e, "entity", "left").join(shared_runs(points), "entity", "left")
    ids = F.when(c("expected_curves") > 0, F.sequence(F.lit(1), c("expected_curves").cast("int")))
    ids = F.transform(ids, lambda x: x.cast("long"))
    passed = [
        c("g0"), c("g1"), c("g2"), c("g3"), c("g4"),
        c("drawn") == ids,
        (c("named") == ids) & (c("temps") == F.array_sort(F.array_distinct("labels"))) & (F.size(F.array_distinct("labels")) == c("expected_curves")) & c("agreed"),
        c("g3") & c("g4") & c("bounded"), c("g3") & c("g4") & c("smooth"),
        (c("checked") == ids) & c("allowed_gap").between(0, 1) & c("sound"),
        c("g10"), c("independent") & (F.coalesce("shared", F.lit(0.0)) <= MOST_SHARED),
    ]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("seq"), F.lit(g).alias("gate"), yes(x).alias("passed")) for i, (g, x) in enumerate(zip(GATES, passed, strict=True))])
    return s.select("entity", F.explode(rows).alias("g")).select("entity", "g.seq", "g.gate", "g.passed", F.when(~c("g.passed"), c("g.gate")).alias("reason"))
