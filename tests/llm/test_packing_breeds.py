"""The breed gets past best fit, and blocks share their emptiest bins."""

import random

import numpy as np
from pyspark.sql import functions as F

from chartmill.llm import packing_gga as G


def triplets(n, capacity=1000, seed=0):
    """Sizes that fill n bins exactly by threes, and that best fit packs badly."""
    r, out = random.Random(seed), []
    for _ in range(n):
        a = r.randint(380, 490)
        b = r.randint(250, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    r.shuffle(out)
    return out


def test_crossover_gains_where_best_fit_is_not_optimal():
    for n, seed in ((60, 0), (200, 2)):
        sizes = triplets(n, seed=seed)
        seeded = len(G._packed(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 1000)[0])
        assigned, bins = G.evolve(sizes, 1000, [0, 1, 0], [])
        again, better = G.evolve(sizes, 1000, [0, 1, 1], [assigned])
        assert G.lower_bound(sizes, 1000) == n <= better <= bins <= n + (seeded - n) // 3 and seeded >= 1.1 * n
        for a in (assigned, again):
            assert (np.bincount(a, weights=sizes) <= 1000).all()


def test_blocks_pool_their_emptiest_bins(spark):
    r = random.Random(5)
    rows = [(i, 0, 0, r.choice([30, 300, 700, 1100]), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = G.pack_pieces(df, 2048, block=40)
    bins = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("c"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert out.count() == 1200 and all(b["n"] == b["end"] <= 2048 for b in bins)
    sizes = [x[3] for x in rows]
    whole = len(G._packed(sizes, sorted(range(1200), key=lambda i: -sizes[i]), 2048)[0])
    assert G.lower_bound(sizes, 2048) <= len(bins) <= whole  # thirty small blocks on their own would need more than one large one
