"""Operators on documents: edge cases with defined results, and brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartmill.llm import langid_crf, license_scan, packing_gga, pareto_mix, parity_join, quality_mcd, shard_shuffle, suffix_dedup, toxicity_subword
from chartmill.llm.tokens import Encoder

KIND = "doc_id long, text string, lang string, source string, n_chars long, node string, label long, k int, size string, row string, copies string"
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(6000)
    base = prose(300)
    near = base.split()
    near[150] = "changed"
    out = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", "en", None, 5), (4, "one", None, "b", 3), (5, "two words", "en", "b", 9),
        (6, base, "en", "a", len(base)), (7, base, "en", "b", len(base)), (7, base, "en", "b", len(base)), (8, " ".join(near), "fr", "a", 1), (9, long, "en", "a", len(long)),
        (10, long[:20000], "de", "c", 1), (None, prose(50), "en", "a", 1), (11, "é" * 500 + " ñandú", "es", "a", 1), (12, "x " * 500, "en", "c", 1), (13, "12 34 !!", "en", "c", 1), (14, "LICENSED under the MIT License", "en", "c", 1), (15, "Licensed under the Apache License, Version 2.0.\nmore " + prose(30), "en", "c", 1), (16, prose(400), "en", "c", 1),
    ]
    return [(*r, "n", 7, 1, "s", "r", "c") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([b" ".join(w)] if 0 < len(w) < 5 else [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)])


def components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(sets)), key=str)


def test_jaccard_edge_cases(docs, rows, empty):
    got = sorted((tuple(r) for r in parity_join.near_duplicates(docs).collect()), key=str)
    assert got == components([(r[0], r[1]) for r in rows])
    assert parity_join.near_duplicates(empty).count() == 0


def test_jaccard_against_brute_force(spark):
    r, out = random.Random(5), []
    for g in range(12):
        base = [r.choice(WORDS) for _ in range(r.choice([4, 5, 6, 9, 14, 30, 90, 260]))]
        shared = [r.choice(WORDS) for _ in range(20)]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            out.append(w + (shared if r.random() < 0.3 else []))
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    got = sorted((tuple(x) for x in parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == components(rows)


def test_rows_without_an_id_link_others(spark):
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(200)]
    rows = []
    for i, cuts in ((500, ()), (None, (20, 60, 100)), (501, (20, 60, 100, 140, 170, 185))):
        w = list(base)
        for c in cuts:
            w[c] = f"new{c}"
        rows.append((i, " ".join(w)))
    a, b, c = (shingles(t) for _, t in rows)
    alike = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert alike(a, b) and alike(b, c) and not alike(a, c)
    got = {x["doc_id"]: x["component_id"] for x in parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {500: 500, 501: 500, None: 500}


def test_one_of_each_keeps_one(docs):
    kept = parity_join.one_of_each(docs)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(6) == 1 and 7 not in ids and 8 not in ids and {1, 2, 3, 9, 10} <= set(ids)
    assert kept.columns == docs.columns


def spans(rows, w):
    data = [(t or "").encode() for _, t in rows]
    count = {}
    for b in data:
        for i in range(len(b) - w + 1):
            count[b[i : i + w]] = count.get(b[i : i + w], 0) + 1
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        gone = suffix_dedup.merged([(i, i + w) for i in range(len(b) - w + 1) if count[b[i : i + w]] > 1])
        at, kept = 0, b""
        for s, e in gone:
            kept += b[at:s]
            at = e
        kept += b[at:]
        out.append((d, len(b), sum(e - s for s, e in gone), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_passages_against_brute_force(docs, rows, empty, spark):
    got = sorted((tuple(r) for r in suffix_dedup.digest(docs, 400).collect()), key=str)
    assert got == spans([(r[0], r[1]) for r in rows], 400)
    assert suffix_dedup.digest(empty).count() == 0
    r = random.Random(8)
    shared = [prose(60, r)[:n] for n in (399, 400, 401, 400)]
    made = []
    for i in range(24):
        parts = [prose(r.randint(5, 80), r)] + [x for x in r.sample(shared, 2)] + [prose(20, r)]
        made.append((i, "|".join(parts)))
    made += [(90, "ab" * 700), (91, "ab" * 350 + "c"), (92, "é" * 450)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    assert sorted((tuple(x) for x in suffix_dedup.digest(df, 400).collect()), key=str) == spans(made, 400)
    old = suffix_dedup.HOT_RUNS
    suffix_dedup.HOT_RUNS = 2  # the aggregate for hot anchors gives the same
    try:
        assert sorted((tuple(x) for x in suffix_dedup.digest(df, 400).collect()), key=str) == spans(made, 400)
    finally:
        suffix_dedup.HOT_RUNS = old


def test_passages_are_cut_from_text(docs):
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    assert 6 not in cut and 7 not in cut and cut[16] and cut[1] is None and cut[2] == ""


def test_multikey_quicksort_sorts():
    g = np.random.default_rng(1)
    t = g.integers(0, 3, (200, 4)).astype(np.uint64)
    group = g.integers(0, 4, 200)
    order = suffix_dedup.multikey_quicksort(t, group)
    keys = [(group[i], *t[i]) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(200))


def test_packing_round_trip(docs, rows, empty):
    path = packing_gga.tokenizer_path()
    got = packing_gga.pack(docs, 2048, path).collect()
    whole = Encoder(path).whole
    want = []
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((r[0], k // 2048, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(x[3] for x in want) // 2048) + 1
    assert packing_gga.pack(empty, 2048, path).count() == 0


def test_breeding_never_loses_an_item():
    g = np.random.default_rng(2)
    sizes = g.integers(1, 2049, 400).tolist()
    first, n = packing_gga.evolve(sizes, 2048, [0, 1, 0], [])
    again, m = packing_gga.evolve(sizes, 2048, [0, 1, 1], [first, first])
    assert m <= n and len(again) == 400
    room = np.bincount(again, weights=sizes)
    assert room.max() <= 2048 and len(room) == m


def test_shards_are_a_seeded_permutation(docs, rows, empty):
    a = sorted((tuple(r) for r in shard_shuffle.shard(docs, 16, bucket_rows=4).collect()), key=str)
    b = sorted((tuple(r) for r in shard_shuffle.shard(docs.repartition(5), 16, bucket_rows=4).collect()), key=str)
    assert a == b and len(a) == len(rows)
    for s in range(16):
        slots = sorted(r[4] for r in a if r[3] == s)
        assert slots == list(range(len(slots))) and len(slots) in (1, 2)
    size = {(r[0], r[1], r[2]) for r in a}
    assert {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows} == size
    assert shard_shuffle.shard(empty).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + j for p in at.values() if len(p) > 1 for i in p for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark, docs, rows, empty):
    extra = [(100 + i, t) for i, t in enumerate(["a b\na b\n \na b", "# *$ %&|<>", prose(12) + " " + "q w e r t y u i o " * 3, "w " * 17])]
    got = quality_mcd.judge(docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)).collect()
    want = sorted((r[0], *counts(r[1])) for r in [x for x in rows if x[0]] + extra)
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got if r["doc_id"]) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality_mcd.judge(empty).count() == 0


def test_robust_distance_finds_outliers(spark):
    r = random.Random(4)
    clean = [(i, prose(r.randint(60, 400), r), "en", "a") for i in range(120)]
    junk = [(1000 + i, " ".join(w + "###$" for w in prose(80, r).split()), "en", "a") for i in range(25)]
    got = {x["doc_id"]: x["kept"] for x in quality_mcd.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


def test_mix_reaches_its_targets(spark, empty):
    r = random.Random(6)
    rows = [(i, prose(r.randint(1, 60), r), s) for i in range(900) for s in [r.choice(["a", "b", "c", None])]] + [(5000, None, "z"), (5001, prose(5), "tiny")] + [(7, "same words", "a")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pareto_mix.mix(df).collect()
    again = pareto_mix.mix(df.repartition(7)).collect()
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    names = sorted({x[2] for x in rows if x[2]}) + [None]
    size = {n: sum(len((x[1] or "").split()) for x in rows if x[2] == n) for n in names}
    w = {n: i % 3 + 1 for i, n in enumerate(names)}
    want, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[n] for n in full)
        want = {n: 3 * size[n] if n in full else left * w[n] / sum(w[m] for m in names if m not in full) for n in names}
        over = {n for n in names if n not in full and want[n] > 3 * size[n]}
        if not over:
            break
        full |= over
    for n in names:
        mine = [x for x in got if x["source"] == n]
        assert all(abs(x["target"] - want[n]) < 1e-6 * max(1, want[n]) and x["taken"] <= 3 * x["size"] for x in mine)
        assert abs(sum(x["taken"] for x in mine) - want[n]) <= max(3, 0.01 * want[n])
    assert pareto_mix.mix(empty).count() == 0


def test_language_of_switched_and_empty_text(spark, docs, empty):
    r = random.Random(1)
    lex = {"aa": ["taka", "raka", "saka", "paka", "lakama"], "bb": ["zivu", "niru", "dilu", "mifu", "girune"]}
    rows = [(i, " ".join(r.choice(lex[k]) for _ in range(r.randint(3, 60))), k) for i in range(160) for k in [r.choice(["aa", "bb"])]]
    rows += [(900, "taka raka zivu " * 9 + "raka saka", None), (901, None, "aa"), (902, "12 !! ,", "bb"), (903, "", "aa")]
    got = {x["doc_id"]: x for x in langid_crf.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i, *_ in rows)
    assert all(got[i]["lang_pred"] == k for i, _, k in rows if i < 900)
    assert got[900]["lang_pred"] == "aa" and got[900]["score"] < 0.95
    assert {got[i]["lang_pred"] for i in (901, 902, 903)} == {"und"} and got[901]["score"] == 0
    assert langid_crf.identify(empty).count() == 0
    assert {x["lang_pred"] for x in langid_crf.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_label_counts_are_exact_forward_backward():
    g = np.random.default_rng(3)
    k, m = 3, np.exp(np.random.default_rng(4).normal(0, 1, (3, 3)))
    lengths = np.array([1, 64, 65, 200, 3])
    p = np.exp(g.normal(0, 1, (lengths.sum(), k)))
    got = langid_crf.label_counts(p.copy(), lengths, m)
    at = 0
    for n, c in zip(lengths, got, strict=True):
        q = p[at : at + n]
        a, b = np.ones((n, k)), np.ones((n, k))
        a[0] = q[0] / q[0].sum()
        for i in range(1, n):
            a[i] = (a[i - 1] @ m) * q[i]
            a[i] /= a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = m @ (q[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        u = a * b
        assert np.allclose((u / u.sum(1, keepdims=True)).sum(0), c)
        at += n


def test_toxicity_shares_ngrams(spark, docs, empty):
    r = random.Random(2)
    bad = ["horridest", "vilenasty", "grimscum"]
    rows, labels = [], []
    for i in range(400):
        w = prose(r.randint(20, 120), r).split()
        y = int(i % 4 == 0)
        if y:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    rows += [(1000, prose(60, r) + " horidest vilenastyy"), (1001, ""), (1002, None)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity_subword.toxicity(df, lab).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == y for i, y in labels if i in held) >= 0.95 * len(held)
    assert got[1000]["predicted"] == 1 and got[1001]["score"] == 0 and got[1002]["predicted"] == 0
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.7) for x in got.values())
    none = toxicity_subword.toxicity(docs, lab.where("toxic = 0"))
    assert {x["score"] for x in none.collect()} == {0.0}
    assert toxicity_subword.toxicity(empty, lab).count() == 0


def test_licences(docs, rows, empty, spark):
    got = {x["doc_id"]: x for x in license_scan.scan(docs).collect()}
    assert got[14]["licences"] == "MIT" and got[15]["licences"] == "Apache-2.0"
    assert all(got[r[0]]["licences"] == "" for r in rows if r[0] not in (14, 15))
    assert got[1]["n_passages"] == 0 and got[2]["n_passages"] == 0 and got[3]["n_passages"] == 0
    assert license_scan.scan(empty).count() == 0
