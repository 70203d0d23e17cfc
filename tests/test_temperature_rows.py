"""Temperature laws: one row an anchor, in one shuffle."""

from chartmill.operators import models as D


def test_law_of_many_parts_in_one_shuffle(spark):
    curves = spark.range(40).selectExpr("id AS part", "explode(array(25D, 125D)) AS temp").selectExpr("part", "temp", "explode(transform(sequence(1, 60), n -> n * 2D)) AS i").where("part <> 3 OR temp = 25").where("part <> 4")
    curves = curves.selectExpr("part", "temp", "i", "3D - CASE WHEN temp > 25 THEN 0.3D ELSE 0D END + sqrt(i / CASE WHEN temp > 25 THEN 3.2D ELSE 4D END) AS v")
    anchors = spark.range(40).selectExpr("id AS part", "25D AS tref", "3D AS vth", "4D AS k", "2D AS p", "CASE WHEN id <> 5 THEN 50D END AS id_gc", "3D + sqrt(12.5D) + CASE WHEN id = 6 THEN 0.5D ELSE 0D END AS vpl")
    law = D.temperature_law(curves, anchors)
    assert law._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["part"]: r for r in law.collect()}
    assert len(got) == 40 and [got[p]["status"] for p in (3, 4, 5, 6, 7)] == ["no_hotter_curve", "no_reference_curve", "nonphysical_anchor", "anchor_off_pivot", "ok"]
    assert abs(got[7]["d_vth_per_k"] + 0.003) < 1e-4 and got[7]["rms"] < 1e-2 and got[3]["rms"] is None
