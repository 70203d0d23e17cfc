"""Each stage on nulls, empty and very long texts, ties, repeated rows and extra columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

r = random.Random(21)
WORDS = ["".join(r.choice("abdefgilmnoprst") for _ in range(r.randint(2, 9))) for _ in range(600)]


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE, LONG, SHARED = prose(120), prose(30_000), prose(51)
ROWS = [
    (1, BASE, "en", "a"), (1, BASE, "en", "a"), (2, BASE + " tail", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \n ", "en", None), (None, prose(80), None, None),
    (6, LONG, "en", "a"), (7, f"{prose(60)} {SHARED} {prose(60)}", "en", "c"), (8, f"{prose(70)}  {SHARED}\n{prose(50)}", "de", "c"), (9, "four words are here", "en", "a"), (10, "four words are here", "en", "a"),
    *[(100 + i, prose(90), "en", "abc"[i % 3]) for i in range(60)],
]
CLASH = ("k", "label", "size", "row", "spans", "start", "d2", "grp", "copies", "node", "block", "_k", "piece")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}).cache()


def rows(df):
    assert df.columns == P.COLUMNS
    return df.collect()


def test_quality_rules(spark, docs):
    got = [x["doc_id"] for x in rows(P.quality_rules(spark, docs, ""))]
    assert got.count(1) == 2 and None in got and {2, 6, 7, 8} <= set(got) and not {3, 4, 5, 9, 10} & set(got)
    assert len([i for i in got if i and i >= 100]) == 60


def test_near_duplicates(spark, docs):
    got = [x["doc_id"] for x in rows(P.near_duplicates(spark, docs, ""))]
    assert sorted(got, key=str) == sorted([1, 3, 4, 5, None, 6, 7, 8, 9, *range(100, 160)], key=str)


def test_repeated_passages(spark, docs):
    got = {}
    for x in rows(P.repeated_passages(spark, docs, "")):
        got.setdefault(x["doc_id"], []).append(x)
        assert x["n_chars"] == (None if x["text"] is None else len(x["text"]))
    assert 1 not in got and got[2][0]["text"].split() == ["tail"] and got[3][0]["text"] is None and got[4][0]["text"] == "" and got[6][0]["text"] == LONG
    for i in (7, 8):
        text = got[i][0]["text"]
        assert SHARED not in " ".join(text.split()) and len(text.split()) == 120 - (i == 8) * 0
    assert {9, 10, None} <= set(got) and all(len(got[i]) == 1 and got[i][0]["text"] == t for i, t, *_ in ROWS if i and i >= 100)


def test_mixing(spark, docs):
    got = [x["doc_id"] for x in rows(P.mixing(spark, docs, ""))]
    again = [x["doc_id"] for x in rows(P.mixing(spark, docs.repartition(5), ""))]
    assert sorted(got, key=str) == sorted(again, key=str) and not {3, 4, 5} & set(got)
    assert max(got.count(i) for i in set(got) if i != 1) <= 3 and got.count(1) <= 6


def test_packing(spark, docs):
    out = P.packing(spark, docs, "").collect()
    assert sum(x["piece"] == 0 for x in out) == len(ROWS) and all(0 < x["length"] <= 2048 and x["offset"] + x["length"] <= 2048 for x in out)
    room = {}
    for x in sorted(out, key=lambda x: (x["sequence_id"], x["offset"])):
        assert room.get(x["sequence_id"], 0) == x["offset"]
        room[x["sequence_id"]] = x["offset"] + x["length"]
    assert sum(x["length"] for x in out if x["doc_id"] in (3, 4)) == 2
