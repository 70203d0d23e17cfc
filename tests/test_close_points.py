"""Segments of points close together, and sets that many rows hold."""

import random
import time
from fractions import Fraction

from chartmill.operators import aggregate as G
from chartmill.operators import curves as C
from chartmill.operators import match as M


def test_three_segments_with_points_close_together(spark):
    r = random.Random(3)
    data = {}
    for c in range(40):
        x = sorted(r.uniform(0, 700) for _ in range(60))
        k = r.randrange(10, 50)
        x[k + 1] = x[k] + 1e-5
        data[c] = [(a, r.uniform(1, 500)) for a in x]

    def sse(p):
        p, k = [(Fraction(a), Fraction(b)) for a, b in p], len(p)
        sx, sy = sum(a for a, _ in p), sum(b for _, b in p)
        xx, xy, yy = (sum(u * v for u, v in q) for q in ([(a, a) for a, _ in p], p, [(b, b) for _, b in p]))
        xx, xy, yy = xx - sx * sx / k, xy - sx * sy / k, yy - sy * sy / k
        return yy - (xy * xy / xx if xx > Fraction(1, 10**12) else 0)

    got = C.three_segments(spark.createDataFrame([(c, x, y) for c, p in data.items() for x, y in p], "curve long, x double, y double")).collect()
    assert len(got) == 40
    for g in got:
        p, i, j = data[g["curve"]], g["first_split"], g["second_split"]
        assert abs(g["sse"] - float(sse(p[:i]) + sse(p[i:j]) + sse(p[j:]))) < 1e-5


def _tokens(spark, sets, n):
    rows = spark.range(n).selectExpr("id", f"array({', '.join('array(' + ', '.join(repr(w) for w in s) + ')' for s in sets)})[int(id % {len(sets)})] AS tokens", "'k' AS key")
    return rows.select("key", "id", "tokens")


def test_medoid_of_many_copies(spark):
    began = time.time()
    got = G.medoids(_tokens(spark, [["a", "b"], ["a", "b", "c"], ["c", "d", "e"]], 90_000), "key").collect()
    assert [tuple(r) for r in got] == [("k", 90_000, 89_998)] and time.time() - began < 60


def test_similar_pairs_of_copies_in_blocks(spark):
    rows = _tokens(spark, [["a", "b"], ["b", "a", "b"], ["a", "b", "c"], ["d"]], 40).unionByName(spark.createDataFrame([("k", 90, []), ("k", 91, []), ("k", 92, None), ("j", 5, ["a", "b"])], "key string, id long, tokens array<string>"))
    sets = {i: frozenset([["a", "b"], ["b", "a", "b"], ["a", "b", "c"], ["d"]][i % 4]) for i in range(40)}
    want = sorted((a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]))
    for block in (3, 1000):
        got = M.similar_pairs(rows, "key", 0.6, block).collect()
        assert sorted((r["a"], r["b"], round(r["similarity"], 6)) for r in got) == want and {r["key"] for r in got} == {"k"}


def test_similar_pairs_of_many_copies(spark):
    began = time.time()
    got = M.similar_pairs(_tokens(spark, [["w", "v", f"x{i}", f"y{i}"] for i in range(10)], 20_000), "key", 0.6)
    assert got.count() == 10 * (2000 * 1999 // 2) and time.time() - began < 60
