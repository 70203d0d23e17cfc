"""Repeated passages counted in words, against brute force."""

import random

from chartmill.llm import suffix_dedup


def brute(texts, n):
    """Word positions that rows of n words cover which start anywhere else too, by text."""
    rows = [(t or "").split() for t in texts]
    count = {}
    for w in rows:
        for i in range(len(w) - n + 1):
            count[tuple(w[i : i + n])] = count.get(tuple(w[i : i + n]), 0) + 1
    return [{k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(i, i + n)} for w in rows]


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    passages = [[word() for _ in range(k)] for k in (50, 51, 52, 60, 75, 130)]
    texts = []
    for i in range(90):
        w = [word() for _ in range(r.randint(0, 160))]
        for _ in range(r.randint(0, 2)):
            at, p = r.randint(0, len(w)), r.choice(passages)
            w[at:at] = p
        texts.append(r.choice([" ", "  ", "\n", " \t"]).join(w))
    long = [word() for _ in range(30_000)]
    return [*texts, texts[3], texts[3], None, "", "x " * 300, " ".join(long), " ".join(long[9000:9070] + long[:40]), "one\x1cword " * 4]


def test_words_against_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in suffix_dedup.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=51).collect()}
    assert [got[i]["n_passage_words"] for i in range(len(texts))] == [len(x) for x in brute([None if t is None else t.encode() for t in texts], 51)]


def test_words_are_cut_whole(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs, 51, "words").collect()}
    for i, (t, gone) in enumerate(zip(texts, brute([None if t is None else t.encode() for t in texts], 51), strict=True)):
        left = [w for k, w in enumerate((t or "").encode().split()) if k not in gone]
        assert (got.get(i) or "").encode().split() == left
        assert i in got or not left
        assert gone or got[i] == t
