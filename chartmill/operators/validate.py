"""Validation ladders: ordered status expressions over evidence columns.

Missing evidence is a status of its own and never a pass: comparisons with nulls or NaN count as false
unless the rule names them. Reasons are arrays in rule order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses under which physical output may be served.
SERVABLE = ("pass", "pass_vendor_qoss_curve_tail", "clipped_chart_completed", "pass_coer_energy", "coss_anchor_only")
#: Charge statuses after which a weaker tier may follow (besides a missing status).
NO_REFERENCE = ("reference_unavailable", "chart_clipped_reference_unavailable")
TRACES = ("Ciss", "Coss", "Crss")
EXTRAPOLATED, ENERGY_TOLERANCE, ANCHOR_TOLERANCE = 0.20, 0.25, 0.10


def known(c: Column) -> Column:
    """c as a number that is neither NaN nor infinite, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(yes(c), F.lit(r)) for c, r in rules]))


def trace_reasons(p: str = "") -> Column:
    """Why a panel's traces are suspect. Columns by trace: <t>_points, <t>_span, <t>_y_range, <t>_rise; common_samples, rank_swaps, crss_bottom, ciss_flatter; vector (boolean)."""
    rules = []
    deficit = F.greatest("Ciss_span", "Coss_span") - F.coalesce("Crss_span", F.lit(0.0))
    bounded = (F.least("Ciss_span", "Coss_span") >= 0.98) & (F.coalesce("Crss_span", F.lit(0.0)) >= 0.85)
    rules.append((F.col("Crss_points").isNotNull() & (~yes(F.col("vector")) | bounded) & (F.greatest("Ciss_span", "Coss_span") >= 0.65) & (deficit > 0.12), "Crss_peer_relative_short_x_span"))
    for t in TRACES:
        there, span = F.col(f"{t}_points").isNotNull(), F.coalesce(f"{t}_span", F.lit(0.0))
        rules += [
            (~there, f"missing_{t}"),
            (there & (F.col(f"{t}_points") < 8), f"{t}_too_few_points"),
            (there & (span < 0.65), f"{t}_short_x_span"),
            (there & (F.coalesce(f"{t}_y_range", F.lit(0)) <= 2) & (span >= F.when(yes(F.col("vector")), 0.9).otherwise(0.8)), f"{t}_flat_full_span_unverified"),
            (there & (known(F.col(f"{t}_rise")) > 0.25), f"{t}_rises_with_vds_unphysical"),
        ]
    rules += [
        (F.coalesce("common_samples", F.lit(0)) < 20, "too_few_common_samples"),
        (~F.coalesce("rank_swaps", F.lit(0)).isin(0, 1), "ciss_coss_rank_swap_count"),
        (F.coalesce("crss_bottom", F.lit(0.0)) < 0.95, "crss_not_bottom"),
        (~yes(F.col("ciss_flatter")), "ciss_not_flatter_than_coss"),
    ]
    return reasons(*rules)


def status_of(found: Column) -> Column:
    return F.when(F.size(found) == 0, "pass").otherwise("suspect")


def panel_status(trusted_axis: Column, trace_status: Column, review: Column) -> Column:
    """ok, overlay-review-required or unverified."""
    return F.when(~yes(trusted_axis), "unverified").when(yes(trace_status == "pass") & ~yes(review), "ok").when(yes(trace_status == "pass"), "overlay-review-required").otherwise("unverified")


def trusted_axis(source: Column, x_scale: Column, y_scale: Column, error: Column) -> Column:
    return yes(source.isNotNull() & (source != "chart_text") & x_scale.isNotNull() & y_scale.isNotNull() & error.isNull())


def charge_status(metrics: Column, extrapolated: Column, clipped: Column, error: Column, tail: Column, table_reference: Column) -> Column:
    """The charge ladder; null where there are no metrics."""
    clip = yes(clipped)
    return (
        F.when(~yes(metrics), F.lit(None).cast("string"))
        .when(yes(tail == "pass"), "pass_vendor_qoss_curve_tail")
        .when(yes(known(extrapolated) > EXTRAPOLATED), "unreliable_extrapolation")
        .when(yes(error == "Qoss table reference unavailable"), F.when(clip, "chart_clipped_reference_unavailable").otherwise("reference_unavailable"))
        .when(clip & error.isNotNull(), F.when(yes(table_reference), "chart_clipped_table_authoritative").otherwise("chart_clipped_reference_unavailable"))
        .when(clip, "clipped_chart_completed")
        .when(error.isNull(), "pass")
        .otherwise("graph_table_inconsistent")
    )


def charge_error(got: dict[str, Column], want: dict[str, Column], extrapolated: Column, tolerance: float = 0.25) -> Column:
    """What a chart's integrals disagree with, or null: names joined in order; a missing reference isn't compared."""
    far = lambda k: yes(F.abs(known(got[k]) - want[k]) / F.nullif(want[k], F.lit(0.0)) > tolerance)
    found = F.array_compact(F.array(F.when(yes(known(extrapolated) > EXTRAPOLATED), "extrapolated"), *[F.when(far(k), F.lit(k)) for k in got]))
    none = F.coalesce(*[want[k] for k in want]).isNull()
    return F.when(none, "Qoss table reference unavailable").when(F.size(found) > 0, F.array_join(found, ";"))


def energy_status(reference: Column, voltage: Column, metrics: Column, extrapolated: Column, clipped: Column, got: Column) -> Column:
    g = known(got)
    return (
        F.when(~yes(reference > 0), "coer_reference_unavailable")
        .when(~yes(voltage > 0), "coer_reference_condition_voltage_unavailable")
        .when(~yes(metrics), "coer_energy_integral_unavailable")
        .when(F.coalesce(extrapolated, F.lit(1.0)) > EXTRAPOLATED, "coer_unreliable_extrapolation")
        .when(yes(clipped), "coer_chart_clipped")
        .when(~yes(g > 0), "coer_energy_integral_unavailable")
        .when(yes(F.abs(g - reference) / reference > ENERGY_TOLERANCE), "coer_graph_table_inconsistent")
        .otherwise("pass_coer_energy")
    )


def anchor_status(any_integral: Column, trace_status: Column, anchor: Column, relative: Column, refused: Column) -> Column:
    """The weakest tier; an available integral reference is checked first, so that a failed one can't be passed by."""
    r = known(relative)
    return (
        F.when(yes(any_integral), "integral_reference_present_anchor_only_not_applicable")
        .when(~yes(trace_status == "pass"), "anchor_only_trace_validation_not_pass")
        .when(anchor.isNull(), "anchor_only_no_coss_anchor")
        .when(refused.isNotNull() | r.isNull(), "anchor_only_coss_anchor_unusable")
        .when(F.abs(r) > ANCHOR_TOLERANCE, "anchor_only_coss_anchor_inconsistent")
        .otherwise("coss_anchor_only")
    )


def weaker_tier(status: Column) -> Column:
    return status.isNull() | status.isin(*NO_REFERENCE)


def final_tier(charge: Column, energy: Column, anchor: Column) -> Column:
    """The charge status, unless it has no reference and the energy or the anchor tier serves."""
    return F.when(~weaker_tier(charge), charge).when(energy == "pass_coer_energy", energy).when(anchor == "coss_anchor_only", anchor).otherwise(charge)


def served(df: DataFrame, status: str, physical: list[str]) -> DataFrame:
    """Physical columns are null unless the status may be served; withheld copies go to diagnostic_<name>."""
    ok = yes(F.col(status).isin(*SERVABLE))
    return df.select(*[c for c in df.columns if c not in physical], *[F.when(ok, F.col(c)).alias(c) for c in physical], *[F.when(~ok, F.col(c)).alias(f"diagnostic_{c}") for c in physical])


def untrusted_source(df: DataFrame, denied: DataFrame, key: str = "vendor") -> DataFrame:
    """ok becomes source_untrusted for vendors in denied (vendor); the diagnostic is added once. denied is a fixed policy list."""
    j = df.join(denied.select(F.col(key).alias("_k"), F.lit(True).alias("_d")).distinct(), F.lower(key) == F.lower("_k"), "left")
    hit = yes(F.col("_d")) & (F.col("status") == "ok")
    return j.select(*[c for c in df.columns if c not in ("status", "diagnostics")], F.when(hit, "source_untrusted").otherwise(F.col("status")).alias("status"), F.when(hit, F.array_union("diagnostics", F.array(F.lit("source_collection_not_part_specific")))).otherwise(F.col("diagnostics")).alias("diagnostics"))


def anchor_floor(trace_px: Column, served_px: Column, log_y: Column, least_px: float = 4.0) -> Column:
    """On a linear axis, evidence under least_px pixels is unresolved; the smaller of both counts, unknown ones aside."""
    return F.when(yes(log_y), "resolved").when(F.least(trace_px, served_px).isNull(), "unknown").when(F.least(trace_px, served_px) < least_px, "unresolved").otherwise("resolved")


def scale_verdict(n_checks: Column, worst: Column, blocking: Column, complete: Column, tolerance: float = 0.10) -> Column:
    """FAIL > incomplete > verified; no check at all is 'unverified'."""
    return F.when(yes(F.abs(known(worst)) > tolerance) | yes(blocking), "FAIL").when(complete.isNotNull() & ~yes(complete), "incomplete").when(yes(n_checks > 0), "verified").otherwise("unverified")


def breakdown_status(value: Column, least: Column, normalised: Column, tolerance: float = 0.02) -> Column:
    """A normalised curve must meet the table's minimum both ways, an absolute one must not fall below it."""
    rel = known(value) / F.nullif(least, F.lit(0.0)) - 1
    return F.when(rel.isNull(), "anchor_unavailable").when(yes(normalised) & (F.abs(rel) > tolerance), "anchor_mismatch").when(rel < -tolerance, "below_minimum").otherwise("ok")


def resistance_reasons(kind: str) -> Column:
    """What speaks against a panel of on-state resistance curves; kind: normalized or absolute over temperature, or current.

    Columns, spans as shares of the axis: n_curves, identity (boolean), x_residual, y_residual, x_span, y_range, at_25 (null where 25 °C
    isn't inside), largest_fall (of the value; over current as a share of the axis), typ_25 and max_25 (absolute panels)."""
    # Bounds and names of reasons
    span = {"current": "drain_current_span_below_threshold"}.get(kind, "temperature_span_below_threshold")
    flat, least = {"normalized": ("normalized_rds_span_below_threshold", 0.15), "absolute": ("absolute_rds_span_below_threshold", 0.15), "current": ("rdson_span_below_threshold", 0.20)}[kind]
    falls, most = {"current": ("rdson_not_nondecreasing_with_drain_current", 0.035)}.get(kind, ("normalized_rds_not_nondecreasing_with_temperature", 0.03))
    identity = {"current": "rdson_current_axis_identity_unverified"}.get(kind, "temperature_axis_identity_unverified")
    c = F.col
    rules = [
        (~yes(c("identity")), identity),
        (F.coalesce(F.greatest("x_residual", "y_residual"), F.lit(99.0)) > 1.5, "axis_residual_exceeds_threshold"),
        (F.coalesce("x_span", F.lit(0.0)) < 0.70, span),
        (F.coalesce("y_range", F.lit(0.0)) < least, flat),
    ]
    if kind != "current":
        rules.append((c("at_25").isNull(), "reference_temperature_not_bracketed"))
    if kind == "normalized":
        rules.append((yes(F.abs(known(c("at_25")) - 1) > 0.06), "normalized_rds_at_reference_outside_tolerance"))
    rules.append((F.coalesce("largest_fall", F.lit(0.0)) > most, falls))
    if kind == "absolute":
        rules.append((yes(c("max_25") <= c("typ_25")), "absolute_rds_typ_max_curve_order_unverified"))
    return F.when(F.coalesce("n_curves", F.lit(0)) == 0, F.array(F.lit("no_full_span_vector_curve"))).otherwise(reasons(*rules))


def gate_charge_status(axis_resolved: Column, unit: Column, assumed: Column, inferred: Column, confidence: Column) -> Column:
    return F.when(~yes(axis_resolved) | unit.isNull(), "unresolved").when(yes(assumed), "axis_assumed").when(yes(inferred), "axis_grid_inferred").when(F.coalesce(known(confidence), F.lit(0.0)) < 0.5, "low_confidence").otherwise("ok")


def drive_status(drive: Column, note: Column) -> Column:
    """A gate drive must be a plain number of 4 V or more, 8 V or more where a note says GaN."""
    v = drive.try_cast("double")
    return F.when(drive.isNull(), "drive_missing").when(v.isNull(), "drive_not_numeric").when(v < 4, "drive_too_low").when(yes(F.lower(note).contains("gan")) & (v < 8), "drive_too_low_for_gan").otherwise("ok")


def ztc_status(chart: Column, model: Column, share: float = 0.20) -> Column:
    """Both crossings must exist and agree within `share`, unless neither does."""
    return F.when(chart.isNull() & model.isNull(), "no_crossing").when(chart.isNull() | model.isNull(), "one_sided").when(F.abs(model / F.nullif(chart, F.lit(0.0)) - 1) > share, "disagree").otherwise("ok")


def plausible_plateau(v: Column) -> Column:
    return yes(F.abs(known(v)).between(1, 12))


def stable_order(ranks: DataFrame, least: int) -> DataFrame:
    """ranks (panel, level, curve, y): the order of curves by y at each level; stable if one order holds at `least` levels or more."""
    w = Window.partitionBy("panel", "level").orderBy("y", "curve")
    o = ranks.withColumn("_k", F.row_number().over(w)).groupBy("panel", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "curve"))), lambda x: x["curve"].cast("string")), ",").alias("order"))
    c = o.groupBy("panel", "order").agg(F.count(F.lit(1)).alias("n"))
    best = c.withColumn("_r", F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("n"), "order"))).where("_r = 1")
    return best.select("panel", F.when(F.col("n") >= least, F.col("order")).alias("order"), "n")
