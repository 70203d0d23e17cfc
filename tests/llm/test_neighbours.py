import numpy as np

from chartmill.llm import ann_kmtree


def test_neighbours_recall_ties_and_bad_vectors(spark):
    g = np.random.default_rng(7)
    centres = g.normal(0, 1, (20, 16))
    v = centres[g.integers(0, 20, 3000)] + g.normal(0, 0.3, (3000, 16))
    v[100:900] = v[100]  # one vector that many rows share
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, [1.0] * 3), (None, [1.0] * 16), (9005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann_kmtree.search(df, leaf_rows=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.arange(3000), np.array([r[1] for r in rows[:3000]])
    hit = 0
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        assert all(abs(score - (x[i] * x[q]).sum()) < 1e-12 for _, i, score in found)
        assert found == sorted(found, key=lambda z: (-z[2], z[1]))
        hit += len(set(want.tolist()) & {i for _, i, _ in found})
    assert hit >= 0.9 * 20 * len(got)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (20, [2.0, 2.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann_kmtree.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 1), (20, 2, 0)]
    assert ann_kmtree.search(df.limit(0)).count() == 0
