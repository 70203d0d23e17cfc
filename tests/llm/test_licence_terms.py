"""Licence scans: integer terms and the pieces of notices in the corpus."""

from pyspark.sql import functions as F

from chartmill.llm import license_scan


def test_terms_are_integers_evaluated_once(spark):
    df = spark.createDataFrame([(1, ["mit", "license", "mit"]), (2, ["gplv3"]), (3, [])], "doc_id long, words array<string>")
    terms = df.select("doc_id", license_scan._terms(F.col("words")).alias("t"))
    assert dict(terms.dtypes)["t"] == "array<int>"
    got = {r["doc_id"]: r["t"] for r in terms.collect()}
    want = {p: spark.range(1).select(license_scan._hash_of(p)).first()[0] for p in ("mit", "license", "mit license", "license mit", "gplv3")}
    assert set(got[1]) == {want[p] for p in ("mit", "license", "mit license", "license mit")} and set(got[2]) == {want["gplv3"]} and got[3] == []
    parts = license_scan._known_parts()
    assert len(set(spark.range(1).select(F.array(*[license_scan._hash_of(p) for p in parts])).first()[0])) == len(parts)


def test_pieces_of_notices_are_no_unknown_class(spark):
    text = "Licensed under the Apache License,\n\n--\nA plain line.\n\nThe general public was there."
    corpus = spark.createDataFrame([(1, text)], "doc_id long, text string")
    notes = license_scan.training_notes(spark, corpus).where(F.col("family") == license_scan.UNKNOWN)
    got = {" ".join(r["words"]) for r in notes.collect()}
    assert "licensed under the apache license" not in got
    assert {"a plain line", "the general public was there"} <= got
