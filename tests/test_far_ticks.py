"""Ticks far from pixel 0 keep their digits."""

from chartmill.operators import axis as A


def test_runs_far_from_pixel_zero(spark):
    values = {1: [3.0, 5.0, 8.0, 2.0, 1.0], 2: [10.0, 20.0, 40.0, 50.0, 50.0], 3: [7.0], 4: [1.0, 2.0, 40.0, 41.0, 42.0]}
    rows = [(a + 10 * k, 40.0 * (off + i), v) for k, off in enumerate((0, 600_011, 4_200_013)) for a, vs in values.items() for i, v in zip((0, 1, 3, 4, 7), vs)]
    got = A.maximal_linear_runs(spark.createDataFrame(rows, "axis long, pixel double, value double"), 2, 3.0, 0.3).collect()
    by = [sorted((r["axis"] % 10, r["start"], r["stop"], round(r["rms"], 3)) for r in got if r["axis"] // 10 == k) for k in range(3)]
    assert by[0] == by[1] == by[2]
    assert (2, 1, 4, 0.0) in by[0] and (1, 1, 3, 0.154) in by[0]
