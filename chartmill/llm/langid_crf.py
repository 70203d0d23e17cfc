"""Language identification of code-switched text by a linear-chain conditional random field.

Each word is a position; its features are hashed affixes (n-grams at the word's edges), inner n-grams
and the word itself (lexicon). Label transitions are learned with the features by gradient ascent on
the conditional likelihood. Forward-backward gives every word's label probabilities; a document's
language is the label with most expected words, its score that label's share of the words.

Training sequences are runs of words from a bounded sample of labelled rows (DOCS_A_LABEL for each
label, RUN words from each, at a place fixed by hash), stitched pairwise so that the model sees switches.
Prediction reads whole texts. Exact forward-backward runs blockwise: transfer matrices of BLOCK words
are multiplied out for all blocks at once, states at block edges follow from these, and then every
block's inside; so a text of any length costs the same per word, and a task holds GROUP words at a time.

Defined results: null text or text without a letter is ``und`` with score 0; with no labelled row,
everything is ``und``; null lang is never a label; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngrams import WordTable, batches_of_words, csr, stripped, word_ngrams

#: The bound of the training sample: rows of each label, and words taken from each.
DOCS_A_LABEL, RUN = 250, 80
#: Hash buckets of features, n-gram sizes (edges included), words of a block and of a group in memory.
BUCKETS, SIZES, BLOCK, GROUP = 1 << 16, (1, 2, 3, 4), 64, 200_000
EPOCHS, RATE, RIDGE = 40, 0.3, 1e-4


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def training_sample(docs: DataFrame, per_label: int = DOCS_A_LABEL, run: int = RUN) -> pd.DataFrame:
    """lang, text: a bounded sample by hash order in each label, a run of words of each row."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    span = 12 * run
    at = 1 + F.pmod(F.xxhash64("doc_id", F.lit(12)), F.greatest(F.length("text") - span, F.lit(1)))
    rows = usable.select("doc_id", "lang", F.substring("text", at, F.lit(span)).alias("text")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label)
    return rows.orderBy("lang", "k").select("lang", "text").toPandas()


def _letters(chunk: str) -> str:
    return "".join(c for c in chunk if c.isalpha())


class Crf:
    """labels, feature weights (BUCKETS x labels), transitions (labels x labels)."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log potentials by word: the mean of its features' weights, times a fixed gain."""
        out, n = np.zeros((len(words), len(self.labels))), np.zeros(len(words))
        for owner, bucket in word_ngrams(words, SIZES, BUCKETS):
            n += np.bincount(owner, minlength=len(words))
            for k in range(len(self.labels)):
                out[:, k] += np.bincount(owner, weights=self.weights[bucket, k], minlength=len(words))
        return out / np.sqrt(np.maximum(n, 1))[:, None]

    @classmethod
    def fit(cls, sample: pd.DataFrame, run: int = RUN) -> "Crf":
        labels = sorted(set(sample["lang"])) if len(sample) else []
        if not labels:
            return cls([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
        code = {x: i for i, x in enumerate(labels)}
        runs = []
        for lang, text in zip(sample["lang"], sample["text"], strict=True):
            words = [w for c in text.lower().split()[1:] if (w := _letters(c))][:run]
            if words:
                runs.append((code[lang], words))
        rng = np.random.default_rng(5)
        order = rng.permutation(len(runs)).tolist()
        half = run // 2
        made = []
        for a, b in zip(order, order[1:] + order[:1], strict=True):  # the first half of one row, then the second half of another
            (x, p), (y, q) = runs[a], runs[b]
            made.append((p[:half] + q[half : 2 * half], [x] * len(p[:half]) + [y] * len(q[half : 2 * half])))
        made = [m for m in made if m[0]]
        vocabulary = sorted({w for words, _ in made for w in words})
        place = {w: i for i, w in enumerate(vocabulary)}
        t, k, n = run, len(labels), len(made)
        word, gold, mask = np.zeros((n, t), dtype=np.int64), np.zeros((n, t), dtype=np.int64), np.zeros((n, t), dtype=bool)
        for i, (words, ys) in enumerate(made):
            word[i, : len(words)] = [place[w] for w in words]
            gold[i, : len(ys)] = ys
            mask[i, : len(ys)] = True
        starts, feature = csr(vocabulary, SIZES, BUCKETS)
        owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[starts, len(feature)]))
        scale = 1 / np.sqrt(np.bincount(owner, minlength=len(vocabulary)))
        used, local = np.unique(feature, return_inverse=True)
        w, a = np.zeros((len(used), k)), np.zeros((k, k))
        gw, ga = np.full_like(w, 1e-6), np.full_like(a, 1e-6)
        one = np.eye(k)
        count = mask.sum()
        for _ in range(EPOCHS):
            e = np.stack([np.bincount(owner, weights=w[local, j], minlength=len(vocabulary)) for j in range(k)], 1) * scale[:, None]
            unary, pair = _marginals(e[word], a, mask)
            diff = np.where(mask[:, :, None], one[gold] - unary, 0.0)
            both = mask[:, 1:] & mask[:, :-1]
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
            by_word = np.stack([np.bincount(word.ravel(), weights=diff[:, :, j].ravel(), minlength=len(vocabulary)) for j in range(k)], 1) * scale[:, None]
            d = np.stack([np.bincount(local, weights=by_word[owner, j], minlength=len(used)) for j in range(k)], 1) / count - RIDGE * w / len(used)
            da = (seen - pair) / count - RIDGE * a
            gw, ga = gw + d * d, ga + da * da
            w, a = w + RATE * d / np.sqrt(gw), a + RATE * da / np.sqrt(ga)
        full = np.zeros((BUCKETS, k))
        full[used] = w
        return cls(labels, full, a)


def _marginals(e: np.ndarray, a: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities by position, and expected transitions in all; rows are padded at their end."""
    n, t, k = e.shape
    p = np.exp(e - e.max(2, keepdims=True))
    m = np.exp(a)
    alpha, beta = np.zeros((n, t, k)), np.ones((n, t, k))
    alpha[:, 0] = p[:, 0] / p[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        step = (alpha[:, i - 1] @ m) * p[:, i]
        step /= step.sum(1, keepdims=True)
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = (beta[:, i + 1] * p[:, i + 1]) @ m.T
        step /= step.sum(1, keepdims=True)
        beta[:, i] = np.where(mask[:, i + 1, None], step, beta[:, i + 1])
    unary = alpha * beta
    unary /= unary.sum(2, keepdims=True)
    both = mask[:, 1:] & mask[:, :-1]
    x, y = alpha[:, :-1][both], (beta[:, 1:] * p[:, 1:])[both]
    z = np.einsum("ni,ij,nj->n", x, m, y)
    return unary, np.einsum("ni,nj->ij", x / z[:, None], y) * m


def label_counts(potentials: np.ndarray, lengths: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected words of each label by text. potentials: positive, words of all texts in a row; m: exp of the transitions; lengths: words by text, each over 0."""
    k = m.shape[0]
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    text_of = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(total) - first[text_of]
    word0 = (np.cumsum(lengths) - lengths)[text_of] + number * BLOCK
    size = np.minimum(BLOCK, lengths[text_of] - number * BLOCK)
    grid = word0[:, None] + np.minimum(np.arange(BLOCK)[None, :], size[:, None] - 1)
    p = potentials[grid]  # total x BLOCK x k
    live = np.arange(BLOCK)[None, :] < size[:, None]
    p /= p.max(2, keepdims=True)
    carry = np.broadcast_to(np.eye(k), (total, k, k)).copy()  # state before the block -> state at its end
    for i in range(BLOCK):
        on = live[:, i]
        step = (carry[on] @ m) * p[on, i][:, None, :]
        carry[on] = step / step.max((1, 2), keepdims=True)
    inverse = np.linalg.pinv(m)
    start, end = np.empty((total, k)), np.empty((total, k))  # forward state before a block's first word, backward state after its last
    order = np.argsort(-blocks, kind="stable")
    a = np.tile(np.ones(k) @ inverse, (len(lengths), 1))  # before a text's first word any label is as likely
    b = np.ones((len(lengths), k))
    for i in range(int(blocks.max()) if len(blocks) else 0):
        on = order[: np.searchsorted(-blocks[order], -i, side="left")]
        at, back = first[on] + i, first[on] + blocks[on] - 1 - i
        start[at] = a[on]
        step = np.einsum("nk,nkj->nj", a[on], carry[at])
        a[on] = step / step.sum(1, keepdims=True)
        end[back] = b[on]
        step = np.einsum("nkj,nj->nk", carry[back], b[on])
        b[on] = step / np.abs(step).max(1, keepdims=True)
    alpha = np.empty((total, BLOCK, k))
    now = start
    for i in range(BLOCK):
        step = (now @ m) * p[:, i]
        now = np.where(live[:, i, None], step / step.sum(1, keepdims=True), now)
        alpha[:, i] = now
    counts = np.zeros((total, k))
    now = end
    for i in range(BLOCK - 1, -1, -1):
        both = alpha[:, i] * now
        both /= both.sum(1, keepdims=True)
        counts += np.where(live[:, i, None], both, 0.0)
        step = (now * p[:, i]) @ m.T
        now = np.where(live[:, i, None], step / step.sum(1, keepdims=True), now)
    return np.add.reduceat(counts, first) if total else np.zeros((len(lengths), k))


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    labels, k = model.labels, len(model.labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.transitions))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, transitions = sent.value
        crf = Crf(labels, weights, transitions)
        m = np.exp(transitions)

        def compute(chunks: list[str]) -> np.ndarray:  # potentials, and 1 where the chunk has a letter
            words = [_letters(c) for c in chunks]
            has = np.array([bool(w) for w in words])
            e = crf.emissions([w or "-" for w in words])
            return np.hstack([np.exp(np.maximum(e - e.max(1, keepdims=True), -30)), has[:, None]])

        table = WordTable(compute, k + 1)
        for pdf in batches:
            lang, score = np.full(len(pdf), "und", dtype=object), np.zeros(len(pdf))
            if k:
                for ids, chunks in batches_of_words(pdf["text"].tolist(), GROUP):
                    rows = table.lookup(chunks) if any(chunks) else np.zeros((0, k + 1))
                    text = np.repeat(np.arange(len(ids)), [len(c) for c in chunks])
                    on = rows[:, k] > 0
                    lengths = np.bincount(text[on], minlength=len(ids))
                    full = np.flatnonzero(lengths)
                    if len(full):
                        counts = label_counts(rows[on, :k], lengths[full], m)
                        best = counts.argmax(1)
                        at = np.array(ids)[full]
                        lang[at] = np.array(labels, dtype=object)[best]
                        score[at] = np.clip(counts[np.arange(len(full)), best] / lengths[full], 0, 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score; learned from rows that aren't held out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = Crf.fit(training_sample(d.where(~held_out(F.col("doc_id"), modulus, remainder))))
    return predict(d, model).select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score")


__all__ = ["Crf", "held_out", "identify", "label_counts", "predict", "stripped", "training_sample"]
