"""Large groups of near copies that are mostly not linked with one another."""

import numpy as np
import pytest

from chartmill.llm import parity_join


def least_reachable(links: np.ndarray) -> np.ndarray:
    label = np.arange(len(links))
    while True:
        new = np.array([label[row].min() for row in links])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("members", [parity_join.MOST_MEMBERS, 700])
def test_three_thousand_edits_of_one_text(spark, monkeypatch, members):
    monkeypatch.setattr(parity_join, "MOST_MEMBERS", members)
    r = np.random.default_rng(3)
    texts, sets = [], []
    for i in range(3000):
        words = [f"w{k}" for k in range(90)]
        for k in r.choice(90, r.integers(2, 9), replace=False):
            words[k] = f"edit{i}x{k}"
        texts.append(" ".join(words))
        sets.append([not any(w.startswith("edit") for w in words[k : k + 5]) for k in range(86)])
    kept = np.array(sets, dtype=np.int64)
    common = kept @ kept.T
    links = 100 * common >= 75 * (2 * 86 - common)
    np.fill_diagonal(links, True)
    assert links.sum() < 0.05 * links.size
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in parity_join.near_duplicates(docs).collect()}
    assert got == {i: (86, int(c)) for i, c in enumerate(least_reachable(links))}


def test_sketches_refuse_no_link():
    r = np.random.default_rng(4)
    base = r.integers(1, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: 200 - 5 * (i % 9)], r.integers(1, 1 << 63, 5 * (i % 9), dtype=np.uint64)]) for i in range(60)]
    alike = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
    for own, block in ((True, [0] * 60), (False, [i % 2 for i in range(60)])):
        rows = [{"node": i, "label": i, "n": len(s), "bits": parity_join._bits(s), "block": b, "own": own} for i, (s, b) in enumerate(zip(sets, block, strict=True))]
        wanted = {frozenset((i, j)) for i in range(60) for j in range(i) if (own or block[i] != block[j]) and alike(sets[i], sets[j])}
        found = [frozenset((rows[i]["node"], rows[j]["node"])) for i, j in parity_join._plausible_in(rows)]
        assert wanted <= set(found) and len(found) == len(set(found))
