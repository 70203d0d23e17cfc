import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartmill.operators import aggregate, axis, curves, interpolate, match, models, validate

PTS = "curve long, x double, y double, seq long"


def curve(spark, f, lo=0.0, hi=80.0, n=400, key=1):
    x = np.linspace(lo, hi, n)
    return spark.createDataFrame([(key, float(v), float(f(v)), i) for i, v in enumerate(x)], PTS)


def test_clean_points_merge_by_median_and_refuse(spark):
    rows = [(1, 1.0, 5.0, 0), (1, 1.0, 9.0, 1), (1, 1.0, 6.0, 2), (1, -3.0, 2.0, 3), (1, float("nan"), 1.0, 4), (1, 2.0, -1.0, 5), (2, 1.0, 1.0, 6), (3, None, None, 7)]
    p = spark.createDataFrame(rows, PTS)
    got = [(r["x"], r["y"]) for r in curves.clean_points(p).orderBy("x").collect()]
    assert got == [(0.0, 2.0), (1.0, 6.0)]
    assert {r["curve"]: r["status"] for r in curves.refused_curves(p).collect()} == {1: "ok", 2: "too_few_samples", 3: "withheld"}


def test_charge_of_a_known_curve(spark):
    p = curve(spark, lambda v: 800 / math.sqrt(1 + v), hi=40.0, n=2000)
    q = curves.charge(p.select("curve", "x", "y")).first()["charge"]
    assert q == pytest.approx(1600 * (math.sqrt(41) - 1), rel=1e-4)
    m = aggregate.coss_metrics(curve(spark, lambda v: 800 / math.sqrt(1 + v), lo=0.1).select("curve", "x", "y"), 40.0).first()
    assert m["qoss"] == pytest.approx(1600 * (math.sqrt(41) - 1), rel=1e-3) and not m["clipped"]
    assert m["phi"] == pytest.approx(1, abs=0.05) and m["m"] == pytest.approx(0.5, abs=0.02)


def test_knots_reach_the_tolerance_with_few_points(spark):
    k = models.adaptive_knots(curve(spark, lambda v: 800 / math.sqrt(1 + v)).select("curve", "x", "y"), 0.02)
    rows = k.collect()
    assert rows[0]["achieved"] <= 0.0200001 and len(rows) < 20
    t = models.charge_table(k, 40.0, 512).orderBy("i").collect()
    assert t[-1]["q"] == pytest.approx(1600 * (math.sqrt(41) - 1), rel=0.01)
    assert all(b["q"] >= a["q"] for a, b in zip(t, t[1:]))
    assert models.spice_text(models.charge_table(k, 40.0, 4)).first()["netlist"].startswith(".func qoss_c1(v) {table(max(v,0), 0,")


# Axes and what the contract says of them
AXES = [
    ([0, 10, 20, 30], [10, 20, 30, 40], "auto", "ok", "linear"),
    ([100, 101, 102, 103], [0, 100, 200, 300], "auto", "ambiguous", None),
    ([100, 101, 102, 103], [0, 100, 200, 300], "linear", "ok", "linear"),
    ([1, 10, 100, 1000], [10, 20, 30, 40], "log10", "ok", "log10"),
    ([-1, 0, 1, 2], [10, 20, 30, 40], "log10", "log_needs_positive", None),
    ([1, 10, 100, 1000], [10, 20, 30, 40], "linear", "residual_untrusted", None),
    ([1], [10], "auto", "too_few_ticks", None),
    ([-1e-13, 0, 1e-13], [0, 1, 2], "auto", "no_candidate", None),
    ([3, 2, 5], [0, 10, 20], "auto", "not_monotone", None),
]


@pytest.mark.parametrize("values,pixels,model,status,kind", AXES)
def test_axis_contract(spark, values, pixels, model, status, kind):
    t = spark.createDataFrame([(1, float(p), float(v)) for v, p in zip(values, pixels)], "axis long, pixel double, value double")
    r = axis.fit_axes(t, model).first()
    assert (r["status"], r["model"]) == (status, kind)
    if kind == "log10":
        assert 10 ** (r["m"] * 40 + r["b"]) == pytest.approx(1000)


def test_three_interpolations_differ_at_the_edges(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 10.0), (1, 100.0, 100.0)], "curve long, x double, y double")
    q = spark.createDataFrame([(1, -5.0), (1, 4.0), (1, 50.0), (1, 100.0), (1, 200.0)], "curve long, px double")
    got = lambda df: {r["px"]: r["value"] for r in df.collect()}
    assert got(interpolate.interp_inside(p, q)) == {-5.0: None, 4.0: 4.0, 50.0: 50.0, 100.0: 100.0, 200.0: None}
    assert got(interpolate.interp_clamped(p, q))[-5.0] == 0.0 and got(interpolate.interp_clamped(p, q))[200.0] == 100.0
    near = {r["px"]: (r["value"], r["reason"]) for r in interpolate.interp_near(p, q, 20.0).collect()}
    assert near[50.0] == (None, "inside_gap") and near[4.0] == (4.0, None) and near[-5.0] == (None, "outside_span")


def test_suppression_is_greedy_and_free_of_partitioning(spark):
    b = [(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 2, 1.0, 0.0, 11.0, 10.0), (1, 3, 3, 6.0, 0.0, 16.0, 10.0), (2, 4, 4, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(b, "page long, id long, seq long, x0 double, y0 double, x1 double, y1 double")
    for n in (1, 5):
        got = {r["id"]: r["accepted"] for r in match.suppress(df.repartition(n)).collect()}
        assert got == {1: True, 2: False, 3: True, 4: True}


def test_greedy_match_uses_each_side_once(spark):
    df = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 2.0), (1, 2, 1, 1.5), (1, 2, 2, 9.0), (1, 3, 3, 99.0)], "grp long, lid long, rid long, distance double")
    assert {(r["lid"], r["rid"]) for r in match.greedy_match(df, 60.0).collect()} == {(1, 1), (2, 2)}


def test_law_recovers_its_parameters(spark):
    df = spark.createDataFrame([(1, 4 + k / 10, 2.5 * (k / 10) ** 2) for k in range(1, 60)], "curve long, v double, i double")
    a = aggregate.square_law(df).first()
    assert a["vth"] == pytest.approx(4) and a["k"] == pytest.approx(2.5)


@pytest.mark.parametrize("pivot,to,agrees", [(50.0, 10.0, True), (5.0, 6.0, False)])
def test_a_pivot_that_the_curve_contradicts_shows(spark, pivot, to, agrees):
    k = 50.0 / 1.5**2
    rows = [(1, 4 + (to - 4) * n / 200, k * ((to - 4) * n / 200) ** 2) for n in range(201)]
    got = aggregate.pivot_vth(spark.createDataFrame(rows, "curve long, v double, i double"), spark.createDataFrame([(1, 5.5, pivot)], "curve long, vpl double, id_pl double")).first()
    assert got["status"] == "ok" and (got["rms"] < 0.01 and got["vth"] == pytest.approx(4, abs=0.02) if agrees else got["rms"] > 0.3)


def test_pivots_without_a_window_are_refused(spark):
    rows = [(1, 4.0 + n, float(n)) for n in range(5)] + [(2, 4.0 + n / 10, n / 10) for n in range(40)]
    piv = spark.createDataFrame([(1, 6.0, 3.0), (2, 6.0, 500.0)], "curve long, vpl double, id_pl double")
    assert {r["curve"]: r["status"] for r in aggregate.pivot_vth(spark.createDataFrame(rows, "curve long, v double, i double"), piv).collect()} == {1: "too_few_points", 2: "short_current_span"}


def test_missing_evidence_never_passes(spark):
    df = spark.createDataFrame([(None, None, None, None)], "a double, b boolean, c string, d string")
    r = df.select(
        validate.charge_status(F.col("b"), F.col("a"), F.col("b"), F.col("c"), F.col("c"), F.col("b")).alias("charge"),
        validate.energy_status(F.col("a"), F.col("a"), F.col("b"), F.col("a"), F.col("b"), F.col("a")).alias("energy"),
        validate.anchor_status(F.col("b"), F.col("c"), F.col("a"), F.col("a"), F.col("d")).alias("anchor"),
        validate.scale_verdict(F.col("a"), F.col("a"), F.col("b"), F.col("b")).alias("scale"),
        validate.weaker_tier(F.col("c")).alias("weaker"),
    ).first()
    assert r["charge"] is None and r["energy"] == "coer_reference_unavailable" and r["anchor"] == "anchor_only_trace_validation_not_pass" and r["scale"] == "unverified" and r["weaker"]
    nan = spark.range(1).select(validate.charge_status(F.lit(True), F.lit(float("nan")), F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True)).alias("s")).first()["s"]
    assert nan == "pass"


@pytest.mark.parametrize("drive,note,ok", [("-4/+18", None, False), (None, None, False), ("10", None, True), ("4.5", None, True), ("5", "GaN FET", False)])
def test_drive_gate(spark, drive, note, ok):
    df = spark.createDataFrame([(drive, note)], "d string, n string")
    assert (df.select(validate.drive_status(F.col("d"), F.col("n")).alias("s")).first()["s"] == "ok") == ok


def test_layout_keys_are_hard_boundaries(spark):
    rows = [("chart|native", "a", "f1", ["x", "y", "z"]), ("chart|native", "b", "f2", ["x", "y", "w"]), ("table|native", "c", "f1", ["x", "y", "z"])]
    df = spark.createDataFrame(rows, "coarse string, id string, fingerprint string, tokens array<string>")
    loose = {r["id"]: (r["coarse"], r["cluster"]) for r in models.cluster_layouts(df, 0.0).collect()}
    assert loose["a"] == loose["b"] != loose["c"]
    tight = {r["id"]: r["cluster"] for r in models.cluster_layouts(df, 0.72).collect()}
    assert tight["a"] != tight["b"]


def test_chains_and_plateaus(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 5.0), (1, 2, 5.1, 5.1, 9.0, 9.0), (1, 3, 50.0, 50.0, 60.0, 60.0)], "panel long, seg long, x0 double, y0 double, x1 double, y1 double")
    assert {r["seg"]: r["component"] for r in models.chain_segments(s).collect()} == {1: 1, 2: 1, 3: 3}
    rows = [(1, float(x), 400.0 - (4 * x if x < 30 else 120 if x < 60 else 120 + 5 * (x - 60))) for x in range(100)] + [(2, float(x), 5.0) for x in range(10)] + [(3, float(x), 400.0 - 3 * x) for x in range(100)]
    boxes = spark.createDataFrame([(k, 0.0, 0.0, 99.0, 400.0) for k in (1, 2, 3)], "curve long, x0 double, y0 double, x1 double, y1 double")
    got = {r["curve"]: (r["y_px"], r["source"]) for r in models.plateau(spark.createDataFrame(rows, "curve long, x double, y double"), boxes).collect()}
    assert got[1] == (pytest.approx(280, abs=1), "window") and got[2] == (None, None) and got[3][0] is not None
