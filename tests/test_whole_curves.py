"""Operators on curves of any length."""

import random

import numpy as np

from chartmill.operators import curves as C


def test_three_segments_of_long_curves(spark):
    r = random.Random(5)
    lengths = {1: 5, 2: 6, 3: 30, 4: 70, 5: 200}
    data = {c: [(float(i) + r.random() / 2, abs(i - n / 3) + r.gauss(0, 2)) for i in range(n)] for c, n in lengths.items()}
    got = {x["curve"]: x for x in C.three_segments(spark.createDataFrame([(c, x, y) for c, p in data.items() for x, y in p], "curve long, x double, y double")).collect()}
    assert sorted(got) == [2, 3, 4, 5]

    def sse(p):
        x, y = np.array(p).T
        return float(np.sum((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2))

    for c in (2, 3, 4):
        p, n = data[c], lengths[c]
        best = min((round(sse(p[:i]) + sse(p[i:j]) + sse(p[j:]), 6), i, j) for i in range(2, n - 3) for j in range(i + 2, n - 1))
        assert abs(got[c]["sse"] - best[0]) < 1e-5 and (got[c]["n_points"], got[c]["first_split"], got[c]["second_split"]) == (n, *best[1:])
    assert got[5]["n_points"] == 200
