"""Panels: drawn strokes, export coordinates, trace checks, axis evidence, table rows and temperature identity.

All of it is joins on a page or panel key, windows by curve and aggregates; nothing is grouped into Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import best_row
from .interpolate import interp_clamped
from .validate import yes


def exported(x: Column, y: Column, box: dict[str, Column]) -> dict[str, Column]:
    """Pixel coordinates as shares of a box of whole pixels, y upwards."""
    return {"x_norm": (x - box["x0"]) / F.greatest(F.lit(1.0), box["x1"] - box["x0"] - 1), "y_norm": (box["y1"] - y) / F.greatest(F.lit(1.0), box["y1"] - box["y0"] - 1)}


def cubic_points(cubics: DataFrame, steps: int = 12) -> DataFrame:
    """cubics (id, ax, ay, bx, by, cx, cy, dx, dy), control points in order -> id, i, x, y: steps + 1 points of each curve, by its power basis."""
    t = F.col("i") / F.lit(float(steps))

    def at(a: str, b: str, c: str, d: str) -> Column:
        one = 3 * (F.col(b) - F.col(a))
        two = 3 * (F.col(c) - F.col(b)) - one
        return F.col(a) + t * (one + t * (two + t * (F.col(d) - F.col(a) - one - two)))

    return cubics.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).select("id", "i", at("ax", "bx", "cx", "dx").alias("x"), at("ay", "by", "cy", "dy").alias("y"))


def curve_strokes(strokes: DataFrame, least_width: float = 0.8, pad: float = 3.0) -> DataFrame:
    """strokes (panel, id, kind, width, red, green, blue, x0, y0, x1, y1, left, top, right, bottom) -> those that can be a curve's.

    Stroked, 0.8 to 2.2 wide, dark or chromatic, their middle inside the plot, and not a long rule on the frame."""
    # Widths, colour bounds, share of the plot that makes a rule long, distance that puts it on the frame
    most_width, dark, chroma, share, edge = 2.2, 0.22, 0.15, 0.45, 1.5
    bright, dim = F.greatest("red", "green", "blue"), F.least("red", "green", "blue")
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = mx.between(F.col("left") - pad, F.col("right") + pad) & my.between(F.col("top") - pad, F.col("bottom") + pad)
    on = lambda v, a, b: (F.abs(v - F.col(a)) <= edge) | (F.abs(v - F.col(b)) <= edge)
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    frame = ((dy < 0.1) & (dx > share * (F.col("right") - F.col("left"))) & on(my, "top", "bottom")) | ((dx < 0.1) & (dy > share * (F.col("bottom") - F.col("top"))) & on(mx, "left", "right"))
    return strokes.where((F.col("kind") == "s") & F.col("width").between(least_width, most_width) & ((bright < dark) | (bright - dim >= chroma)) & inside & ~frame)


def pixel_columns(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points (curve, i, x, y) along a drawn line, boxes (curve, x0, y0, x1, y1) -> curve, x, y: one row a pixel column.

    Each segment is sampled at its longer side's pixels; jumps over 8 % of the width and 25 % of the height are gaps. A column of
    four or more samples in the first 12 % keeps its top, any other its rounded median."""
    # Fixed values
    jump_x, jump_y, knee, pad = 0.08, 0.25, 0.12, 4
    w = Window.partitionBy("curve").orderBy("i")
    s = points.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).where("nx IS NOT NULL AND NOT (nx = x AND ny = y)").join(boxes, "curve")
    dx, dy, wide, high = F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    s = s.where(~((F.abs(dx) > jump_x * wide) & (F.abs(dy) > jump_y * high)))
    n = F.greatest(F.lit(1), F.rint(F.greatest(F.abs(dx), F.abs(dy))).cast("int"))
    s = s.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    s = s.select("curve", "x0", "y0", "x1", "y1", F.rint(F.col("x") + dx * (F.col("k") / F.col("n"))).cast("long").alias("px"), F.rint(F.col("y") + dy * (F.col("k") / F.col("n"))).cast("long").alias("py"))
    s = s.where(F.col("px").between(F.col("x0") - pad, F.col("x1") + pad) & F.col("py").between(F.col("y0") - pad, F.col("y1") + pad))
    top = (F.count(F.lit(1)) >= 4) & (F.col("px") <= F.first("x0") + knee * (F.first("x1") - F.first("x0")))
    return s.groupBy("curve", "px").agg(F.when(top, F.min("py")).otherwise(F.rint(F.median("py"))).cast("long").alias("y")).select("curve", F.col("px").alias("x"), "y")


def trace_checks(points: DataFrame, names: tuple[str, str, str] = ("Ciss", "Coss", "Crss"), samples: int = 200) -> DataFrame:
    """points (panel, trace, x, y), whole pixels, y downwards -> panel, common_samples, rank_swaps, crss_bottom, ciss_flatter; panels with all three traces.

    Swaps are changes of sign of the upper two's difference on shared columns, zeros left out; the share of samples with the third
    at the bottom is over the common span."""
    one, two, three = names
    p = points.where(F.col("trace").isin(*names))
    span = p.groupBy("panel", "trace").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.max("y") - F.min("y")).alias("range"))
    g = span.groupBy("panel").agg(F.count(F.lit(1)).alias("n"), F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.max(F.when(F.col("trace") == one, F.col("range"))).alias("r1"), F.max(F.when(F.col("trace") == two, F.col("range"))).alias("r2")).where("n = 3")
    step = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / samples)).cast("long")
    at = g.where("hi >= lo").withColumn("px", F.explode(F.sequence(F.col("lo"), F.col("hi"), step)))
    key = lambda t: F.concat_ws("|", F.col("panel").cast("string"), t)
    mids = p.groupBy("panel", "trace", "x").agg(F.median("y").alias("y"))
    probes = at.select(F.explode(F.array(*[F.lit(t) for t in names])).alias("trace"), "panel", F.col("px").cast("double").alias("px")).select(key(F.col("trace")).alias("curve"), "px", "panel", "trace")
    read = interp_clamped(mids.select(key(F.col("trace")).alias("curve"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), probes)
    wide = read.groupBy("panel", "px").agg(*[F.max(F.when(F.col("trace") == t, F.col("value"))).alias(f"v{i}") for i, t in enumerate(names)])
    bottom = wide.groupBy("panel").agg(F.count(F.lit(1)).alias("common_samples"), F.avg((F.col("v2") >= F.greatest("v0", "v1")).cast("double")).alias("crss_bottom"))
    both = mids.groupBy("panel", "x").agg(*[F.max(F.when(F.col("trace") == t, F.col("y"))).alias(f"y{i}") for i, t in enumerate((one, two))]).withColumn("s", F.signum(F.col("y0") - F.col("y1"))).where("s <> 0")
    before = F.lag("s").over(Window.partitionBy("panel").orderBy("x"))
    swaps = both.withColumn("swap", F.coalesce((before != F.col("s")).cast("long"), F.lit(0))).groupBy("panel").agg(F.sum("swap").alias("swaps"))
    out = g.join(bottom, "panel", "left").join(swaps, "panel", "left")
    return out.select("panel", F.coalesce("common_samples", F.lit(0)).cast("long").alias("common_samples"), F.coalesce("swaps", F.lit(0)).cast("long").alias("rank_swaps"), F.coalesce("crss_bottom", F.lit(0.0)).alias("crss_bottom"), (F.col("r1") < F.col("r2")).alias("ciss_flatter"))


def pairwise_collapse(points: DataFrame, within: float = 1.5) -> DataFrame:
    """points (panel, trace, row, x): traces as x by whole pixel row -> panel, first, second, rows, collapsed: every pair, the share of common rows where both are `within` of each other."""
    span = points.groupBy("panel", "trace").agg(F.min("row").alias("lo"), F.max("row").alias("hi"))
    a, b = (span.select("panel", F.col("trace").alias(n), F.col("lo").alias(f"{n}_lo"), F.col("hi").alias(f"{n}_hi")) for n in ("first", "second"))
    pair = a.join(b, "panel").where("first < second").withColumn("lo", F.greatest("first_lo", "second_lo")).withColumn("hi", F.least("first_hi", "second_hi")).where("hi >= lo")
    rows = pair.select("panel", "first", "second", F.explode(F.sequence("lo", "hi")).alias("row"))
    key = lambda t: F.concat_ws("|", F.col("panel").cast("string"), F.col(t).cast("string"))
    curve = points.select(key("trace").alias("curve"), F.col("row").cast("double").alias("x"), F.col("x").cast("double").alias("y"))
    probes = rows.select("panel", "first", "second", "row", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    probes = probes.withColumn("trace", F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("second"))).select(key("trace").alias("curve"), F.col("row").cast("double").alias("px"), "panel", "first", "second", "side")
    got = interp_clamped(curve, probes).groupBy("panel", "first", "second", "px").agg((F.max(F.when(F.col("side") == 0, F.col("value"))) - F.max(F.when(F.col("side") == 1, F.col("value")))).alias("d"))
    return got.groupBy("panel", "first", "second").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.abs("d") <= within).cast("double")).alias("collapsed"))


def ranked_temperatures(curves: DataFrame, temperatures: DataFrame) -> DataFrame:
    """curves (panel, curve, v, i) and temperatures (panel, tj) -> panel, curve, tj, status, for panels of three curves or more.

    Below the crossover a hotter curve lies further left: curves ranked by gate voltage at a low shared current take the
    temperatures from the hottest down, if they are strictly apart there and in the same order at a second current."""
    name = F.concat_ws("|", F.col("panel").cast("string"), F.col("curve").cast("string"))
    pts = curves.where("i > 0").groupBy("panel", "curve", F.col("i").alias("x")).agg(F.max("v").alias("y"))
    size = curves.groupBy("panel", "curve").agg(F.max("i").alias("top")).groupBy("panel").agg(F.count(F.lit(1)).alias("n"), F.min("top").alias("hi")).where("n > 2")
    labels = temperatures.groupBy("panel").agg(F.sort_array(F.collect_list("tj"), asc=False).alias("tjs"))
    g = size.join(labels, "panel", "left")
    # The two currents
    at = F.array(F.greatest(F.lit(0.5), 0.12 * F.col("hi")), F.greatest(F.lit(0.75), 0.18 * F.col("hi")))
    probes = curves.select("panel", "curve").distinct().join(g.where("hi > 0"), "panel").select("panel", "curve", F.posexplode(at).alias("k", "px"))
    read = interp_clamped(pts.select(name.alias("key"), "x", "y").withColumnRenamed("key", "curve"), probes.select(name.alias("key"), "px", "panel", F.col("curve").alias("of"), "k").withColumnRenamed("key", "curve"))
    w = Window.partitionBy("panel", "k").orderBy("value", "of")
    ranked = read.withColumn("rank", F.row_number().over(w)).withColumn("tied", F.coalesce(F.col("value") <= F.lag("value").over(w), F.lit(False)))
    both = ranked.groupBy("panel", F.col("of").alias("curve")).agg(F.max(F.when(F.col("k") == 0, F.col("rank"))).alias("rank"), F.max(F.when(F.col("k") == 1, F.col("rank"))).alias("rank2"), F.max("tied").alias("tied"))
    panel = both.groupBy("panel").agg(F.max("tied").alias("tied"), F.max(F.col("rank") != F.col("rank2")).alias("moved"))
    status = F.when(F.coalesce(F.size("tjs"), F.lit(0)) != F.col("n"), "count_mismatch").when(~yes(F.col("hi") > 0), "no_common_current").when(yes(F.col("tied")), "not_separated").when(yes(F.col("moved")), "order_changes").otherwise("ok")
    s = g.join(panel, "panel", "left").withColumn("status", status)
    out = curves.select("panel", "curve").distinct().join(s, "panel").join(both.select("panel", "curve", "rank"), ["panel", "curve"], "left")
    return out.select("panel", "curve", F.when(F.col("status") == "ok", F.get("tjs", F.col("rank") - 1)).alias("tj"), "status")


def tick_evidence(ticks: DataFrame) -> DataFrame:
    """ticks (axis, value, y) of gate-voltage axes -> axis, n, evidenced, quality_n, quality_fit, quality_rows, quality_span.

    Evidenced: two ticks or more over a volt and 15 points, rising upwards, off their line by 0.25 V or 6 % of the span at most,
    between -20 and 30. Quality is over one row a value, the one closest to the common line."""
    line = ticks.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "y").alias("m"), F.regr_intercept("value", "y").alias("b"), (F.max("value") - F.min("value")).alias("span"), (F.max("y") - F.min("y")).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    t = ticks.join(line, "axis").withColumn("off", F.abs(F.col("value") - (F.col("m") * F.col("y") + F.col("b"))))
    worst = t.groupBy("axis").agg(F.max("off").alias("worst"))
    # Fixed values
    good = (F.col("n") >= 2) & (F.col("span") >= 1.0) & (F.col("rows") >= 15.0) & (F.col("m") < 0) & (F.col("worst") <= F.greatest(F.lit(0.25), 0.06 * F.col("span"))) & (F.col("lo") >= -20.0) & (F.col("hi") <= 30.0)
    one = best_row(t.select("axis", "value", "y", F.round("off", 9).alias("off")), ["axis", "value"], F.asc("off"), F.asc("y"))
    fit = one.groupBy("axis").agg(F.count(F.lit(1)).alias("qn"), F.regr_slope("value", "y").alias("qm"), F.regr_intercept("value", "y").alias("qb"), (F.max("value") - F.min("value")).alias("qspan"), (F.max("y") - F.min("y")).alias("qrows"))
    off = one.join(fit, "axis").groupBy("axis").agg(F.max(F.abs(F.col("value") - (F.col("qm") * F.col("y") + F.col("qb")))).alias("qoff"))
    out = line.join(worst, "axis").join(fit, "axis").join(off, "axis", "left")
    two = F.col("qn") >= 2
    return out.select("axis", "n", yes(good).alias("evidenced"), F.when(two, F.col("qn")).otherwise(0).alias("quality_n"), F.when(two, -F.col("qoff") / F.greatest(F.lit(1.0), F.col("qspan"))).otherwise(-1e9).alias("quality_fit"), F.when(two, F.col("qrows")).otherwise(0.0).alias("quality_rows"), F.when(two, F.col("qspan")).otherwise(0.0).alias("quality_span"))


def own_axis(columns: DataFrame) -> DataFrame:
    """columns (panel, column, gap, n) of tick labels -> the panel's own: nearest to the frame; the number of labels only breaks exact ties. Columns of one label don't count."""
    return best_row(columns.where("n >= 2"), ["panel"], F.asc("gap"), F.desc("n"), F.asc("column"))


def beyond_ticks(y: Column, lowest: Column, highest: Column, n: Column, slack: float = 0.10) -> Column:
    """A level lies outside the measured ticks by more than a tenth of their span."""
    span = highest - lowest
    return yes((n >= 2) & (span > 0) & ~y.between(lowest - slack * span, highest + slack * span))


def table_rows(boxes: DataFrame, rules: DataFrame, words: DataFrame) -> DataFrame:
    """boxes (page, id, x0, y0, x1, y1), rules (page, x0, y, x1), words (page, text, cy) -> page, id, shallow, crossref.

    Shallow: two rules above and below enclose a row of 5 to 28 points; crossref: such a row holds two numbers and a unit."""
    # Heights, slacks and the units that count
    units = ["a", "v", "nc", "pc", "pf", "nf", "ω", "mω"]
    r = rules.select("page", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("y").alias("ry"))
    wide, high, mid = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), (F.col("x0") + F.col("x1")) / 2
    near = boxes.where((wide > 0) & high.between(3.0, 36.0)).join(r, "page").where((F.col("rx1") - F.col("rx0") >= F.greatest(F.lit(60.0), 0.40 * wide)) & mid.between(F.col("rx0"), F.col("rx1")) & F.col("ry").between(F.col("y0") - 4, F.col("y1") + 4))
    g = near.groupBy("page", "id", "y0", "y1").agg(F.array_sort(F.collect_set("ry")).alias("ys"))
    upper = F.filter("ys", lambda y: y <= F.col("y0") + 0.5 * (F.col("y1") - F.col("y0")) + 1)
    lower = F.filter("ys", lambda y: y >= F.col("y1"))
    shallow = F.exists(upper, lambda a: F.exists(lower, lambda b: (b - a).between(5.0, 28.0)))
    found = g.where(shallow).select("page", "id", "y0", "y1")
    unit = F.regexp_replace(F.lower("text"), "[^a-zωΩ]+", "")
    w = found.join(words, "page").where(F.col("cy").between(F.col("y0") - 5, F.col("y1") + 5)).groupBy("page", "id").agg((F.count_if(F.trim("text").rlike(r"^[+-]?\d+(?:\.\d+)?$")) >= 2).alias("numbers"), F.max(unit.isin(units)).alias("unit"))
    out = boxes.select("page", "id").join(found.select("page", "id", F.lit(True).alias("s")), ["page", "id"], "left").join(w, ["page", "id"], "left")
    return out.select("page", "id", yes(F.col("s")).alias("shallow"), yes(F.col("s") & F.col("numbers") & F.col("unit")).alias("crossref"))


def paintable(status: Column, review: Column) -> tuple[Column, Column]:
    """Whether a result may be painted, and why; review asks for those that wait for one as well."""
    ok, waits = status.isin("ok", "pass", "verified"), status.isin("overlay-review-required")
    allowed = yes(ok) | yes(waits & review)
    return allowed, F.when(yes(ok), "accepted_status").when(allowed, "explicit_review_overlay").otherwise(F.concat(F.lit("status_not_embeddable:"), F.coalesce(status, F.lit(""))))


def union_families(families: dict[str, DataFrame]) -> DataFrame:
    """Records of several families, of different columns, with their family's name."""
    parts = [df.withColumn("family", F.lit(name)) for name, df in sorted(families.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_paths(paths: DataFrame, n: int) -> DataFrame:
    """The first n paths in order: a bounded run that repeats."""
    return paths.orderBy("path").limit(n)


def ocr_words(tsv: DataFrame, least: float = 10.0) -> DataFrame:
    """tsv (page, tsv, width_pt, height_pt, width_px, height_px) of word boxes with a header line -> page, line, text, x0, y0, x1, y1 in points.

    Rows without text, with a confidence under `least`, or whose numbers don't parse are left out."""
    lines = tsv.withColumn("_l", F.split("tsv", "\r?\n")).withColumn("_h", F.split(F.get("_l", F.lit(0)), "\t"))
    rows = lines.select("page", "_h", *["width_pt", "height_pt", "width_px", "height_px"], F.posexplode("_l").alias("line", "row")).where("line > 0").withColumn("_c", F.split("row", "\t"))
    cell = lambda name: F.get("_c", (F.array_position("_h", name) - 1).cast("int"))
    number = lambda name: F.trim(cell(name)).try_cast("double")
    r = rows.select("page", "line", F.trim(cell("text")).alias("text"), number("conf").alias("conf"), *[number(c).alias(c) for c in ("left", "top", "width", "height")], (F.col("width_pt") / F.greatest(F.lit(1), F.col("width_px"))).alias("sx"), (F.col("height_pt") / F.greatest(F.lit(1), F.col("height_px"))).alias("sy"))
    r = r.where((F.length("text") > 0) & (F.col("conf") >= least) & F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull())
    return r.select("page", "line", "text", (F.col("left") * F.col("sx")).alias("x0"), (F.col("top") * F.col("sy")).alias("y0"), ((F.col("left") + F.col("width")) * F.col("sx")).alias("x1"), ((F.col("top") + F.col("height")) * F.col("sy")).alias("y1"))


def strict_json(text: Column, schema: str) -> Column:
    """A struct of a JSON text; null where it isn't valid or holds NaN or an infinity outside quotes."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', '""')
    return F.when(~bare.rlike(r"NaN|Infinity"), F.from_json(text, schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"}))


def caption_direction(captions: DataFrame, plots: DataFrame, axes: DataFrame) -> DataFrame:
    """Where a caption's plot lies. captions (page, caption, family, x0, y0, x1, y1, page_width), plots (page, px0, py0, px1, py1), axes (page,
    family, wx0, wy0, wx1, wy1: a word that names an axis of the family) -> page, caption, by_axis, leads_nearer, by_gap.

    by_axis: above or below, by the nearest such word in the column that the caption itself doesn't hold; leads_nearer: one grid
    follows at 28 points or less, nearer by 8 than any before; by_gap: the materially nearer plot within 36 points, above if in doubt."""
    # Shares of the page, distances by family, gaps and margins
    column, far, wide, lead, near, margin = 0.22, 260.0, 340.0, 28.0, 36.0, 8.0
    c = captions.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    w = c.join(axes, ["page", "family"]).where(~((F.col("wx0") < F.col("x1")) & (F.col("x0") < F.col("wx1")) & (F.col("wy0") < F.col("y1")) & (F.col("y0") < F.col("wy1"))))
    wy, dx = (F.col("wy0") + F.col("wy1")) / 2, F.abs((F.col("wx0") + F.col("wx1")) / 2 - F.col("cx"))
    most = F.when(F.col("family").isin("breakdown_voltage", "capacitances"), wide).otherwise(far)
    w = w.withColumn("wy", wy).withColumn("gap", F.abs(wy - F.col("cy"))).where((dx <= column * F.col("page_width")) & (F.col("gap") <= most))
    word = best_row(w.select("page", "caption", "y0", "y1", "wy", "gap"), ["page", "caption"], F.asc("gap"), F.asc("wy")).select("page", "caption", F.when(F.col("wy") > F.col("y1"), "below").when(F.col("wy") < F.col("y0"), "above").alias("by_axis"))
    p = c.join(plots, "page").where((F.col("px0") < F.col("x1")) & (F.col("x0") < F.col("px1")))
    below, above = F.when(F.col("py0") >= F.col("y1"), F.col("py0") - F.col("y1")), F.when(F.col("py1") <= F.col("y0"), F.col("y0") - F.col("py1"))
    g = p.groupBy("page", "caption").agg(F.min(below).alias("b"), F.min(above).alias("a"), F.count(below).alias("nb"))
    beats = F.col("a").isNull() | (F.col("b") + margin < F.col("a"))
    leads = yes((F.col("nb") == 1) & (F.col("b") <= lead) & beats)
    gap = F.when(yes((F.col("b") <= near) & beats), "below").when(yes(F.col("a") <= near), "above").when(yes(F.col("b") <= near), "below")
    out = captions.select("page", "caption").join(word, ["page", "caption"], "left").join(g, ["page", "caption"], "left")
    return out.select("page", "caption", "by_axis", leads.alias("leads_nearer"), gap.alias("by_gap"))


def axis_tiers(attempts: DataFrame) -> DataFrame:
    """attempts (panel, tier, ok, error) of position, grid, text_order and ocr -> panel, tier, trusted, errors.

    Position comes first, then grid lines; the order of texts stands in where both fail but is never trusted, so recognised labels
    go before it. Missing tiers count as failed; errors are those of the tiers that were tried and failed, in this order."""
    order = ("position", "grid", "text_order", "ocr")
    ok = {t: F.coalesce(F.max(F.when(F.col("tier") == t, F.col("ok"))), F.lit(False)).alias(f"ok_{t}") for t in order}
    said = [F.max(F.when((F.col("tier") == t) & ~F.coalesce("ok", F.lit(False)), F.concat(F.lit(f"{t}: "), F.coalesce("error", F.lit("failed"))))).alias(f"why_{t}") for t in order]
    g = attempts.groupBy("panel").agg(*ok.values(), *said)
    tried = {"position": F.lit(True), "grid": ~F.col("ok_position"), "text_order": F.lit(True), "ocr": ~F.col("ok_position") & ~F.col("ok_grid")}
    tier = F.when(F.col("ok_position"), "position").when(F.col("ok_grid"), "grid").when(F.col("ok_ocr"), "ocr").when(F.col("ok_text_order"), "text_order")
    errors = F.array_join(F.array_compact(F.array(*[F.when(tried[t], F.col(f"why_{t}")) for t in order])), "; ")
    return g.select("panel", tier.alias("tier"), yes(tier.isin("position", "grid", "ocr")).alias("trusted"), errors.alias("errors"))


def log_axis_evidence(labels: DataFrame) -> DataFrame:
    """labels (axis, value, pixel) of an upright axis -> axis, n_decades, ladder, contradicted, corroborated.

    ladder: four labels or more, no two alike, none negative, with even steps (5 %), rising upwards and on a line (3 % of a step).
    contradicted: a log reading of two decades or more that such a ladder explains better, as it holds labels beyond the decades.
    corroborated: every other positive label lies where the decades' line puts it, or there is none."""
    # Bounds of the ladder; pixels and share of the span that a label may miss the decades' line by
    even, tight, miss, share = 0.05, 0.03, 1.5, 0.02
    w = Window.partitionBy("axis").orderBy("value", F.desc("pixel"))
    t = labels.withColumn("_dv", F.col("value") - F.lag("value").over(w)).withColumn("_dp", F.col("pixel") - F.lag("pixel").over(w))
    power = F.round(F.log10(F.when(F.col("value") > 0, F.col("value"))))
    t = t.withColumn("_k", F.when(yes(F.abs(F.pow(F.lit(10.0), power) / F.col("value") - 1) < 1e-9), power))
    g = t.groupBy("axis").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("d"), F.min("value").alias("least"), F.median("_dv").alias("step"), F.max("_dv").alias("widest"), F.min("_dv").alias("narrowest"), F.max("_dp").alias("rise"),
        F.sqrt(F.greatest(F.regr_syy("value", "pixel") - F.regr_sxy("value", "pixel") * F.regr_sxy("value", "pixel") / F.nullif(F.regr_sxx("value", "pixel"), F.lit(0.0)), F.lit(0.0)) / F.count(F.lit(1))).alias("off"),
        F.count("_k").alias("decades"), F.regr_slope("_k", "pixel").alias("m"), F.regr_intercept("_k", "pixel").alias("b"), (F.max(F.when(F.col("_k").isNotNull(), F.col("pixel"))) - F.min(F.when(F.col("_k").isNotNull(), F.col("pixel")))).alias("span"),
    )
    ladder = (F.col("n") >= 4) & (F.col("d") == F.col("n")) & (F.col("least") >= 0) & (F.col("step") > 0) & (F.greatest(F.col("widest") - F.col("step"), F.col("step") - F.col("narrowest")) <= F.greatest(F.lit(1e-9), even * F.col("step"))) & (F.col("rise") < 0) & (F.col("off") <= F.greatest(F.lit(1e-6), tight * F.col("step")))
    taken = t.where("_k IS NOT NULL").select("axis", "pixel").distinct()
    peers = t.where("_k IS NULL AND value > 0").join(taken, ["axis", "pixel"], "left_anti").join(g.select("axis", "m", "b", "span"), "axis")
    far = F.abs((F.log10("value") - F.col("b")) / F.nullif("m", F.lit(0.0)) - F.col("pixel")) > F.greatest(F.lit(miss), share * F.col("span"))
    p = peers.groupBy("axis").agg(F.count(F.lit(1)).alias("peers"), F.count_if(F.coalesce(far, F.lit(True))).alias("off_line"))
    out = g.join(p, "axis", "left")
    corroborated = F.when(F.col("decades") < 2, F.lit(True)).when(~yes(F.col("span") > 0), F.lit(False)).when(F.col("peers").isNull(), F.lit(True)).otherwise(F.col("off_line") == 0)
    return out.select("axis", F.col("decades").alias("n_decades"), yes(ladder).alias("ladder"), yes((F.col("decades") >= 2) & ladder & (F.col("n") > F.col("decades"))).alias("contradicted"), corroborated.alias("corroborated"))


def merged_ticks(labels: DataFrame, gap: float = 3.0) -> DataFrame:
    """labels (axis, value, pixel) -> axis, value, pixel, n: labels printed on one row (steps of `gap` pixels at most) as one tick, by medians."""
    w = Window.partitionBy("axis").orderBy("pixel", "value")
    new = F.coalesce((F.col("pixel") - F.lag("pixel").over(w) > gap).cast("int"), F.lit(0))
    g = labels.withColumn("_new", new).withColumn("_row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("axis", "_row").agg(F.median("value").alias("value"), F.median("pixel").alias("pixel"), F.count(F.lit(1)).alias("n")).drop("_row")


def waveform_definitions(captions: DataFrame, pages: DataFrame) -> DataFrame:
    """captions (page, number, title, text), pages (page, text) -> page, number, definition: gate-charge waveforms that define terms.

    Their panel holds fewer than two plain numbers, and the figure next to them in the same ten, or the page's text under the
    figure number before, is a gate-charge test or measurement circuit."""
    from ..functions.text import compact, normalised

    t = captions.withColumn("_t", normalised(F.col("title")))
    words = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: F.btrim(x, F.lit("(),;:"))), lambda x: x.rlike(r"^[+-]?\d+(?:\.\d+)?$"))
    mine = t.withColumn("_w", F.col("_t").contains("gate charge") & F.col("_t").contains("waveform") & (F.size(words) < 2)).withColumn("_ten", F.floor(F.col("number") / 10))
    circuit = t.where(F.col("_t").rlike(r"\bgate charge (?:test|measurement) circuit\b")).select("page", F.floor(F.col("number") / 10).alias("_ten"), F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number")).where(F.floor(F.col("number") / 10) == F.col("_ten")).select("page", "number").distinct().withColumn("_beside", F.lit(True))
    whole = pages.select("page", compact(F.col("text")).alias("_page"))
    j = mine.join(circuit, ["page", "number"], "left").join(whole, "page", "left")
    said = F.lit(False)
    for prefix in ("fig", "figure", "diagram"):
        for kind in ("test", "measurement"):
            said = said | F.contains(F.col("_page"), F.concat(F.lit(prefix), (F.col("number") - 1).cast("string"), F.lit(f"gatecharge{kind}circuit")))
    return j.select("page", "number", yes(F.col("_w") & (yes(F.col("_beside")) | yes(said))).alias("definition"))
