"""Licence scans: repeated rows, counts, very long texts and the calibrated bound."""

from pyspark.sql import functions as F

from chartmill.llm import license_scan

NOTE = "Licensed under the MIT License."


def test_rows_count_once_and_lines_alike(spark):
    long_line = " ".join(f"word{i}" for i in range(200)) + " " + NOTE + " " + " ".join(f"more{i}" for i in range(30))
    rows = [(1, NOTE), (1, NOTE), (2, NOTE), (3, f"{NOTE}\n{NOTE}\nplain line"), (4, long_line), (None, NOTE), (None, NOTE), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "line": F.lit(2), "p": F.lit(3)})
    got = [(r["doc_id"], r["n_passages"], r["n_licence_passages"], r["licences"]) for r in license_scan.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1, "MIT"), (1, 1, 1, "MIT"), (2, 1, 1, "MIT"), (3, 3, 2, "MIT"), (4, 1, 1, "MIT"), (None, 1, 1, "MIT"), (None, 1, 1, "MIT"), (5, 0, 0, ""), (6, 0, 0, "")], key=str)


def test_a_notice_deep_in_a_long_text(spark):
    text = "\n".join(f"line {i} of plain words that say nothing in particular" for i in range(20_000)) + f"\n{NOTE}\n" + "\n".join("tail words" for _ in range(5000))
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_passages"], r["n_licence_passages"], r["licences"]) == (25_001, 1, "MIT")


def test_the_bound_comes_from_rows_set_aside(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    notes = license_scan.training_notes(spark, docs)
    aside = notes.where("aside")
    scanner = license_scan.train(spark, docs)
    scored = scanner.scored(aside.select("words", F.col("family").alias("truth"))).toPandas()
    unknown, over = scored["truth"] == license_scan.UNKNOWN, scored["licensed"] >= scanner.bound
    assert 0.5 < scanner.bound < 1 and over[unknown].mean() < 0.05 and over[~unknown].mean() >= 0.97
    other = spark.createDataFrame([(1, "Licensed under the Press Agreement."), (2, "Distributed under the terms of the General Public Health Plan.")], "doc_id long, text string")
    assert {r["licences"] for r in license_scan.scan(other, scanner).collect()} == {""}
