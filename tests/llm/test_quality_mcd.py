"""The determinant estimate against numpy, and what it keeps and rejects."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from chartmill.llm import quality_mcd as Q


def brute(x, core=Q.CORE):
    """(centre, core covariance) of the least determinant from the same three starts, with exact cores."""
    h = math.ceil(core * len(x))
    med = np.median(x, 0)
    d = np.maximum(1.4826 * np.median(abs(x - med), 0), 1 / 1024)
    z = (x - med) / d
    unit = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
    best = None
    for c in (np.eye(4), np.corrcoef(np.tanh(z).T), unit.T @ unit):
        r = 0.99 * c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
        np.fill_diagonal(r, 1)
        m, s, last = med, r * np.outer(d, d), math.inf
        while True:
            y = x - m
            near = np.argsort((y * np.linalg.solve(s, y.T).T).sum(1), kind="stable")[:h]
            m2, s2 = x[near].mean(0), np.cov(x[near].T, bias=True)
            det = np.linalg.det(s2)
            if det >= last * (1 - 1e-9):
                break
            m, s, last = m2, s2, det
        if best is None or last < best[0]:
            best = last, m, s
    return best[1:]


def sample(n=1500, seed=5):
    r = np.random.default_rng(seed)
    mix = np.array([[1, 0.6, 0, 0], [0, 0.5, 0.3, 0], [0, 0, 0.8, 0.2], [0.1, 0, 0, 0.4]])
    x = r.normal(size=(n, 4)) @ mix + 3
    x[: n // 6] = r.normal(size=(n // 6, 4)) * 0.2 + np.array([9.0, -4, 3, 8])
    return x


def frame(spark, x, grp="g"):
    return spark.createDataFrame([(grp, *map(float, r)) for r in x], "grp string, " + ", ".join(f"{c} double" for c in Q.MEASURES))


def test_distances_agree_with_numpy(spark):
    x = sample()
    rows = frame(spark, x)
    fit = Q.minimum_determinant(rows)
    got = {tuple(round(r[c], 9) for c in Q.MEASURES): r["d2"] for r in Q._distance(rows, fit, True).collect()}
    m, s = brute(x)
    y = x - m
    want = (y * np.linalg.solve(Q.FACTOR * s, y.T).T).sum(1)
    have = np.array([got[tuple(round(v, 9) for v in r)] for r in x.tolist()])
    assert np.median(abs(have / want - 1)) < 0.01 and np.quantile(abs(have / want - 1), 0.99) < 0.05
    assert (have[:250] > 100).all() and (have[250:] > Q.CUTOFF).mean() < 0.002
    again = Q.minimum_determinant(rows.repartition(7)).collect()
    assert again == fit.collect()


def test_determinants_never_rise(spark):
    rows = frame(spark, sample(seed=6)).cache()
    fit = Q._c_step(rows, Q._starts(rows, [1e-12] * 4, True), [1e-12] * 4, True)
    last = None
    for _ in range(5):
        now = {r["start"]: r["logdet"] for r in Q._factored(fit).select("start", "logdet").collect()}
        assert len(now) == 3 and (last is None or all(now[k] <= last[k] + 1e-3 for k in now))
        last = now
        fit = Q._c_step(rows, spark.createDataFrame(fit.collect(), fit.schema), [1e-12] * 4, True)


def test_scatter_is_the_data_s_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = docs.select("lang", "text", *[c.alias(n) for n, c in Q.base_columns(F.col("text")).items()]).withColumns(Q.measures(F.col("text")))
    rows = stats.select(F.coalesce("lang", F.lit("-")).alias("grp"), *Q.MEASURES).distinct().cache()
    pooled = rows.agg(*[F.var_pop(c).alias(c) for c in Q.MEASURES]).first()
    for r in Q.minimum_determinant(rows).collect():
        assert all(Q.RIDGE * pooled[c] < 0.001 * r[f"s_{i}_{i}"] for i, c in enumerate(Q.MEASURES))


def test_groups_of_equal_rows_long_texts_and_names_that_clash(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    one = prose(200)
    rows = [(i, one, "en", "copies") for i in range(200)] + [(1000 + i, prose(150), "en", "copies") for i in range(100)] + [(5000, prose(60_000), "en", "copies"), (5001, None, None, None), (5001, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"d2": F.lit("x"), "grp": F.lit("y"), "start": F.lit(1), "m_0": F.lit(2.0)})
    got = Q.judge(df, keep=("lang", "source")).collect()
    assert len(got) == len(rows) and len({r["kept"] for r in got if r["doc_id"] < 200}) == 1
    assert all(r["kept"] for r in got if r["doc_id"] < 5001) and not any(r["kept"] for r in got if r["doc_id"] == 5001)
