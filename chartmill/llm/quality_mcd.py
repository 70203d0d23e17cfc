"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 8-word windows inside each row's own
arrays (no shuffle). The verdict is multivariate: the counts become a vector of size-free measures; per
language and source, a minimum covariance determinant estimate gives centre and scatter of the cleanest
three quarters, and rows far off by Mahalanobis distance are rejected.

Measures are the log of mean word length, shrunk for short texts, and logs of the shares of symbols,
repeated lines and repeated words. Most texts have none of these three, and a share that is nearly
always 0 has no scatter of its own; so a share counts from its resolution, dithered by a factor of 1/2 to
2 that a hash of the text fixes. Scatter is the core's covariance; only 1e-6 of the pooled variance is
added, against singularity.

The estimate starts from three scatters about the coordinatewise median (median deviations, the
correlation of tanh scores, that of spatial signs), and C-steps go on until no determinant falls; the
start with the least determinant counts. A C-step is two aggregates by group: a histogram of distances on
a log scale finds the core's bound (rows of the bin at the bound count by the share that is needed), then
come sums of products of the rows within. Both combine map-side, and a histogram has at most 2 * SPAN * BINS
bins, so no task holds a group. Equal texts count once in an estimate.

Defined results: null and wordless texts have n_words 0 and fail the base rules; null lang or source
is a group of its own; groups under MIN_GROUP rows use the estimate of their language, and where that
is as small nothing is rejected by distance; repeated rows get equal verdicts; an empty table gives
no rows; extra columns other than those in `keep` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, small_side, written

MEASURES = ["word_length", "symbols", "dup_lines", "repeats"]
#: Resolution of the shares: symbols of characters, repeated lines of lines, repeated words of words.
RESOLUTION = {"symbols": 0.006, "dup_lines": 0.05, "repeats": 0.03}
#: Words of five characters that every text's mean word length starts from.
PRIOR_WORDS = 20
#: Share of a group that the determinant is minimised over, its consistency factor for 4 dimensions (chi-square: 0.75 / P6(q4(0.75))).
CORE, FACTOR = 0.75, 1.485
#: Bins for a factor of two in the squared distance, factors of two to either side of 1, share of the pooled variance added, the fall
#: of a log determinant that counts, and C-steps after which it is an error (a handful are usual).
BINS, SPAN, RIDGE, FALL, MOST_STEPS = 128, 40, 1e-6, 1e-3, 200
#: Squared Mahalanobis distance beyond which a row is rejected: chi-square with 4 degrees of freedom at 1 - 1e-6.
CUTOFF = 33.4
MIN_GROUP = 30
#: Tables of one row a group are broadcast up to so many groups (counted), so that a hot group's rows stay where they are.
SMALL_GROUPS = 20_000
SYMBOLS = "#*$%&|<>"


def _bind(value: Column, f) -> Column:
    """f of a value that is computed once a row, although f's lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _covered(windows: Column, width: int) -> Column:
    """Words covered by windows (an array of hashes by position) that occur twice or more."""
    at = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        twin = lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"]))

    grow = lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(i, acc["end"])).cast("bigint").alias("n"), (i + width).cast("int").alias("end"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("int").alias("end"))
    return F.aggregate(_bind(at, positions), start, grow, lambda acc: acc["n"])


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside width-word windows that the array holds twice or more, the first occurrences included. Windows compare by 64-bit hash."""

    def of(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        counted = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(_covered(w, width))
        return F.when(F.size(h) > width, _bind(windows, counted)).otherwise(F.lit(0).cast("bigint"))

    return _bind(F.transform(words, lambda w: F.xxhash64(w)), of)


def base_columns(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(words),
    }


def measures(text: Column) -> dict[str, Column]:
    """The transformed vector, from base_columns() and the text that fixes the dither."""

    def share(name: str, part: str, whole: str) -> Column:
        uniform = F.shiftrightunsigned(F.xxhash64(text, F.lit(name)), 11) / F.lit(float(1 << 53))
        return F.log(F.col(part) / F.greatest(F.col(whole), F.lit(1)) + RESOLUTION[name] * F.pow(F.lit(2.0), 2 * uniform - 1))

    return {
        "word_length": F.log((F.col("word_chars") + 5 * PRIOR_WORDS) / (F.col("n_words") + PRIOR_WORDS)),
        "symbols": share("symbols", "n_symbols", "word_chars"),
        "dup_lines": share("dup_lines", "n_dup_lines", "n_lines"),
        "repeats": share("repeats", "n_repeat_words", "n_words"),
    }


P = len(MEASURES)
_MEANS = [f"m_{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_SCATTER = [f"s_{i}_{j}" for i, j in _PAIRS]


def _factored(fit: DataFrame) -> DataFrame:
    """fit (grp, start, m_i, s_i_j) + the scatter's Cholesky factor l_i_j and logdet."""
    for j in range(P):
        for i in range(j, P):
            known = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            left = F.col(f"s_{i}_{j}") - known
            fit = fit.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-15))) if i == j else left / F.col(f"l_{j}_{j}"))
    return fit.withColumn("logdet", sum((2 * F.log(f"l_{j}_{j}") for j in range(P)), F.lit(0.0)))


def _distance(rows: DataFrame, fit: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """rows (grp, ...) + start, m_i and d2, the squared Mahalanobis distance from their group's fits."""
    f = _factored(fit).select(F.col("grp").alias("_grp"), "start", *_MEANS, *[f"l_{i}_{j}" for i, j in _PAIRS])
    out = rows.join(small_side(f, small), F.col("grp") == F.col("_grp"), how)
    for i, name in enumerate(MEASURES):
        known = sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y_{i}", (F.col(name) - F.col(f"m_{i}") - known) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(P)), F.lit(0.0))).select(*rows.columns, "start", *_MEANS, "d2")


def _rounded(fit: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last digits: rounded, reruns agree."""
    return fit.select("grp", "start", *[F.round(c, 12).alias(c) for c in [*_MEANS, *_SCATTER]])


def _starts(rows: DataFrame, ridge: list[float], small: bool) -> DataFrame:
    """Three first fits of each group. Medians are of values rounded to 1/1024, so their state is bounded."""
    coarse = lambda c: F.round(c * 1024) / 1024
    mid = rows.groupBy("grp").agg(*[F.percentile(coarse(F.col(c)), 0.5).alias(f"m_{i}") for i, c in enumerate(MEASURES)])
    on = lambda other: small_side(other.withColumnRenamed("grp", "_grp"), small)
    off = rows.join(on(mid), F.col("grp") == F.col("_grp"))
    mad = off.groupBy("grp", *_MEANS).agg(*[F.greatest(1.4826 * F.percentile(coarse(F.abs(F.col(c) - F.col(f"m_{i}"))), 0.5), F.lit(1 / 1024)).alias(f"d_{i}") for i, c in enumerate(MEASURES)])
    z = rows.join(on(mad), F.col("grp") == F.col("_grp"))
    for i, c in enumerate(MEASURES):
        z = z.withColumn(f"z_{i}", (F.col(c) - F.col(f"m_{i}")) / F.col(f"d_{i}"))
    norm = F.greatest(F.sqrt(sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(P)), F.lit(0.0))), F.lit(1e-9))
    z = z.withColumn("norm", norm)
    sums = [F.covar_pop(F.tanh(f"z_{i}"), F.tanh(f"z_{j}")).alias(f"t_{i}_{j}") for i, j in _PAIRS] + [F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / (F.col("norm") * F.col("norm"))).alias(f"g_{i}_{j}") for i, j in _PAIRS]
    found = z.groupBy("grp", *_MEANS, *[f"d_{i}" for i in range(P)]).agg(*sums)

    def scatter(k: int, i: int, j: int) -> Column:
        scale = F.col(f"d_{i}") * F.col(f"d_{j}")
        if i == j:
            return scale + ridge[i]
        if k == 0:
            return F.lit(0.0)
        v = "t" if k == 1 else "g"
        # a little below the correlation, so that the matrix is definite
        return 0.99 * scale * F.col(f"{v}_{i}_{j}") / F.sqrt(F.greatest(F.col(f"{v}_{i}_{i}") * F.col(f"{v}_{j}_{j}"), F.lit(1e-12)))

    starts = F.array(*[F.struct(F.lit(k).alias("start"), *_MEANS, *[scatter(k, i, j).alias(f"s_{i}_{j}") for i, j in _PAIRS]) for k in range(3)])
    return _rounded(found.select("grp", F.explode(starts).alias("f")).select("grp", "f.*"))


def _c_step(rows: DataFrame, fit: DataFrame, ridge: list[float], small: bool) -> DataFrame:
    """The fits of the rows nearest to the given fits."""
    at = F.floor(F.least(F.greatest(F.log2(F.col("d2") + 1e-300), F.lit(-SPAN)), F.lit(SPAN)) * BINS)
    far = _distance(rows, fit, small).withColumn("bin", at)
    counts = far.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("grp", "start")
    upto = counts.withColumn("upto", F.sum("c").over(own.orderBy("bin"))).withColumn("core", F.ceil(CORE * F.sum("c").over(own)))
    edge = upto.where((F.col("upto") >= F.col("core")) & (F.col("upto") - F.col("c") < F.col("core")))
    cut = edge.select(F.col("grp").alias("_g"), F.col("start").alias("_s"), F.col("bin").alias("edge"), "core", ((F.col("core") - F.col("upto") + F.col("c")) / F.col("c")).alias("part"))
    core = far.join(small_side(cut, small), (F.col("grp") == F.col("_g")) & (F.col("start") == F.col("_s"))).where(F.col("bin") <= F.col("edge"))
    w = F.when(F.col("bin") < F.col("edge"), 1.0).otherwise(F.col("part"))
    y = [F.col(c) - F.col(f"m_{i}") for i, c in enumerate(MEASURES)]
    sums = core.groupBy("grp", "start", "core", *_MEANS).agg(*[F.sum(w * y[i]).alias(f"y_{i}") for i in range(P)], *[F.sum(w * y[i] * y[j]).alias(f"q_{i}_{j}") for i, j in _PAIRS])
    mean = [F.col(f"y_{i}") / F.col("core") for i in range(P)]
    moved = [(F.col(f"m_{i}") + mean[i]).alias(f"m_{i}") for i in range(P)]
    scatter = [(F.col(f"q_{i}_{j}") / F.col("core") - mean[i] * mean[j] + (ridge[i] if i == j else 0.0)).alias(f"s_{i}_{j}") for i, j in _PAIRS]
    return _rounded(sums.select("grp", "start", *moved, *scatter))


def minimum_determinant(rows: DataFrame, small: bool = True) -> DataFrame:
    """rows (grp, measures) -> grp, start, m_i, s_i_j: the best start's centre and consistent scatter. Groups step until their
    determinant falls no more; a step that doesn't lower it isn't taken."""
    pooled = rows.agg(*[F.var_pop(c).alias(c) for c in MEASURES]).first()
    ridge = [RIDGE * (pooled[c] or 0.0) + 1e-12 for c in MEASURES]
    columns = ["grp", "start", *_MEANS, *_SCATTER]
    state = written(_starts(rows, ridge, small).withColumn("logdet", F.lit(1e300)).withColumn("fell", F.lit(True)), "mcd-start")
    for _ in range(MOST_STEPS):
        new = _factored(_c_step(rows, state.where("fell").select(columns), ridge, small)).select(*columns, "logdet")
        old = state.select(F.col("grp").alias("_g"), F.col("start").alias("_s"), *[F.col(c).alias(f"o_{c}") for c in [*columns[2:], "logdet"]], F.col("fell").alias("live"))
        both = old.join(small_side(new, small), (F.col("grp") == F.col("_g")) & (F.col("start") == F.col("_s")), "left")
        lower = F.coalesce(F.col("logdet") < F.col("o_logdet"), F.lit(False))
        state = written(both.select(F.col("_g").alias("grp"), F.col("_s").alias("start"), *[F.when(lower, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in [*columns[2:], "logdet"]], F.coalesce(F.col("o_logdet") - F.col("logdet") > FALL, F.lit(False)).alias("fell")), "mcd-state")
        if not state.agg(F.max("fell")).first()[0]:
            break
    else:
        raise RuntimeError(f"no convergence in {MOST_STEPS} steps")
    best = state.groupBy("grp").agg(F.min_by(F.struct(*columns[1:]), F.struct("logdet", "start")).alias("f")).select("grp", "f.*")
    return best.select("grp", "start", *_MEANS, *[(FACTOR * F.col(c)).alias(c) for c in _SCATTER])


def robust_distance(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """stats (lang, source, measures ...) + d2; null where the row's group and language are both too small to judge."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    keyed = stats.withColumn("_l", text("lang")).withColumn("_g", F.concat_ws("\x1f", text("lang"), text("source")))
    by_group = written(keyed.groupBy("_l", "_g").agg(F.count(F.lit(1)).alias("_n")), "mcd-groups")
    few = by_group.count() <= SMALL_GROUPS
    size = by_group.select(F.col("_g").alias("_g2"), F.when(F.col("_n") >= min_group, F.col("_g")).otherwise(F.col("_l")).alias("grp"))
    rows = written(keyed.join(small_side(size, few), F.col("_g") == F.col("_g2")).drop("_g2", "_g"), "mcd-rows")
    # A language's own estimate is over all its rows, so small groups are judged by the whole language.
    small = rows.where(F.col("grp") == F.col("_l")).select("_l").distinct().withColumnRenamed("_l", "_s")
    pooled = rows.join(small_side(small, few), F.col("_l") == F.col("_s"), "left_semi").withColumn("grp", F.col("_l"))
    fitted = rows.where(F.col("grp") != F.col("_l")).unionByName(pooled).select("grp", *MEASURES).distinct()
    fitted = written(fitted, "mcd-vectors")
    enough = fitted.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_group).select(F.col("grp").alias("_e"))
    fit = minimum_determinant(fitted.join(small_side(enough, few), F.col("grp") == F.col("_e"), "left_semi"), few)
    return _distance(rows, fit, few, "left").drop("grp", "_l", "start", *_MEANS)


def judge(docs: DataFrame, keep: tuple[str, ...] = (), min_group: int = MIN_GROUP) -> DataFrame:
    """docs (doc_id, text, lang, source, keep ...) -> doc_id, keep ..., base counts, base_failed, distance, kept."""
    d = docs.select("doc_id", "text", "lang", "source", *[F.col(c).alias(f"_keep_{c}") for c in keep])
    stats = d.select("doc_id", "text", "lang", "source", *[f"_keep_{c}" for c in keep], *[c.alias(n) for n, c in base_columns(F.col("text")).items()])
    stats = stats.withColumns(measures(F.col("text"))).drop("text")
    far = robust_distance(stats, min_group)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = far.withColumn("base_failed", failed).withColumn("distance", F.sqrt("d2")).withColumn("kept", ~failed & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF))
    return out.select("doc_id", *[F.col(f"_keep_{c}").alias(c) for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
