"""The toxicity model: gradients by finite differences, bags by brute force, held-out accuracy from several random starts."""

import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from chartmill.llm import toxicity_subword as T
from chartmill.llm.ngrams import csr, stripped


def test_gradients_by_finite_differences():
    r = np.random.default_rng(0)
    emb, soft, bias = r.normal(size=(7, 3)), r.normal(size=(3, 2)), r.normal(size=2)
    row, column, share = np.array([0, 0, 1, 2, 2, 2, 3]), np.array([1, 2, 1, 6, 3, 0, 5]), r.random(7)
    target, weight = np.array([0, 1, 1, 0]), np.array([0.2, 0.5, 0.1, 0.2])
    _, *got = T.gradients(emb, soft, bias, (row, column, share), target, weight)
    for x, g in zip((emb, soft, bias), got, strict=True):
        for at in np.ndindex(x.shape):
            old, loss = x[at], []
            for h in (1e-6, -1e-6):
                x[at] = old + h
                loss.append(T.gradients(emb, soft, bias, (row, column, share), target, weight)[0])
            x[at] = old
            assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-6)


def test_bags_average_words_and_their_ngrams():
    words = ["horrid", "stream", "a", "horrids"]
    starts, feature = csr(words, T.SIZES, T.BUCKETS)
    known = np.full(T.BUCKETS, -1, dtype=np.int32)
    used = np.unique(feature)
    known[used] = np.arange(len(used))
    bags = T.Bags([np.array([0, 1, 0]), np.array([2]), np.array([3, 1])], starts, feature, known)
    ends = np.r_[starts[1:], len(feature)]
    for k, bag in enumerate(([0, 1, 0], [2], [3, 1])):
        want = np.zeros(len(used))
        for w in bag:
            for f in feature[starts[w] : ends[w]]:
                want[known[f]] += 1 / len(bag) / (ends[w] - starts[w])
        _, column, share = bags.rows(np.array([k]))
        got = np.zeros(len(used))
        got[column] = share
        assert np.allclose(got, want, atol=1e-6)


def test_the_most_toxic_words_of_each_text():
    z, n = np.array([1.0, 5, 3, 2, 9, 9, 0, 4]), np.array([3, 1, 4])
    at, text = T.most_toxic(z, n)
    assert [sorted(z[at[text == k]].tolist()) for k in range(3)] == [[3, 5], [2], [9, 9]]


@pytest.mark.parametrize("seed", [9, 4])
def test_held_out_rows_from_any_start(seed):
    d = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    marks = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if r["toxic"] is not None and texts.get(r["doc_id"])}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in marks}
    sample = pd.DataFrame([(y, texts[i]) for i, y in sorted(marks.items()) if not held[i]], columns=["toxic", "text"])
    sample = pd.concat([sample[sample["toxic"] == c].iloc[: T.ROWS[1 - c]] for c in (1, 0)])
    model = T.Subword.fit(sample, seed=seed)
    hit = {0: [], 1: []}
    for i, y in marks.items():
        words = [w for c in texts[i].lower().split() if (w := stripped(c))]
        if held[i] and words:
            hit[y].append(model.probability(model.logit(model.words(words), np.array([len(words)])))[0] >= 0.7)
    assert np.mean(hit[1]) >= 0.9 and np.mean(hit[0]) < 0.01
