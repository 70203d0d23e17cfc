"""Repeated ids, lengths, clashing columns and the growth of the neighbour tree."""

import numpy as np
from pyspark.sql import functions as F

from chartmill.llm import ann_kmtree


def brute(rows, k):
    """query -> (score, id) of the k best rows: the least vector of an id asks; identical rows count once."""
    width = max(len(v) for _, v in rows)
    there = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for q in sorted({i for i, _ in there if i % 20 == 0}):
        own = min(v for i, v in there if i == q)
        pad = lambda v: np.r_[v, np.zeros(width - len(v))]
        best = sorted((-float((pad(v) * pad(own)).sum()), i) for i, v in there if (i, v) != (q, own))[:k]
        out[q] = [(-s, i) for s, i in best]
    return out


def test_rows_of_one_id_lengths_and_names_that_clash(spark):
    g = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in g.integers(-4, 5, 3 if i % 17 == 0 else 6)]) for i in g.integers(0, 120, 400)]
    rows = [r for r in rows if any(r[1])] + [(40, [2.0, 1.0]), (40, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"h1": F.lit(1), "q": F.lit(2), "v": F.lit(3), "c": F.lit(4), "ids": F.lit(5), "leaf": F.lit(6), "rank": F.lit(7)})
    got = {}
    for r in ann_kmtree.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == brute(rows, 20)


def test_queries_of_a_grove_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ann_kmtree, "QUERY_ROWS", 3)
    monkeypatch.setattr(ann_kmtree, "BLOCK_ROWS", 40)
    g = np.random.default_rng(5)
    rows = [(i, [float(x) for x in g.normal(size=5)]) for i in range(600)]
    got = {}
    for r in ann_kmtree.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, 20)
    assert sum(len({i for _, i in want[q]} & set(got[q])) for q in want) >= 0.97 * 20 * len(want) and all(len(x) == 20 for x in got.values())


def test_leaves_grow_with_the_table():
    assert ann_kmtree.leaves_for(60) == 1 and ann_kmtree.leaves_for(51_000) == 340
    assert ann_kmtree.leaves_for(10**7) == 12_649 and ann_kmtree.leaves_for(10**9) == 126_491
