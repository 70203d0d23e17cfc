"""Very long texts, repeated rows and ties in the operators on language and mixing."""

import random

from chartmill.llm import langid_crf, pareto_mix

r = random.Random(8)
EN = ["the", "and", "house", "with", "water", "under", "thing", "could", "right", "there", "which", "light"]
DE = ["und", "nicht", "haus", "wasser", "unter", "dinge", "könnte", "recht", "dort", "welche", "licht", "straße"]


def prose(words, n):
    return " ".join(r.choice(words) for _ in range(n))


def test_language_of_long_and_repeated_rows(spark):
    rows = [(i, prose(EN if i % 2 else DE, r.randint(20, 60)), "en" if i % 2 else "de") for i in range(300)]
    long = prose(EN, 50_000)
    rows += [(1000, long, None), (1000, long, None), (1001, prose(DE, 9), None), (1001, rows[0][1], None), (1002, rows[0][1], "de")]
    got = langid_crf.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append((x["lang_pred"], round(x["score"], 9)))
    assert len(set(by[1000])) == 1 and by[1000][0][0] == "en" and {x for x, _ in by[1001]} == {"de"} and by[1002][0] in by[1001]
    assert sum(by[i][0][0] == g for i, _, g in rows[:300]) >= 295


def test_mix_with_a_long_document_and_ties(spark):
    rows = [(i, "two words", "a") for i in range(40)] + [(5, "two words", "a")] * 2 + [(100, prose(EN, 40_000), "b"), (101, prose(EN, 60), "b"), (102, prose(EN, 60), "b"), (103, None, "c"), (104, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pareto_mix.mix(df, keep=("text",)).collect()
    assert sorted(map(str, got)) == sorted(map(str, pareto_mix.mix(df.repartition(6), keep=("text",)).collect()))
    assert len(got) == len(rows) and all(x["taken"] == x["copies"] * x["size"] <= 3 * x["size"] for x in got)
    a = [x for x in got if x["source"] == "a"]
    assert abs(sum(x["taken"] for x in a) - a[0]["target"]) <= 2 and sum(x["doc_id"] == 5 for x in a) == 3
