"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of its hashed character n-gram embeddings (the word itself among them), a bag's hidden
layer the mean of its words' vectors, and a two-way softmax sits on top; embeddings and softmax start at random and
are trained jointly, by minibatch Adam in numpy. Misspelt words share n-grams with known ones.

Labels are of whole texts, of which a toxic one has few toxic words. So the model learns first from bags of all words
of a text, and then, in rounds, from the bag of those words of each text, toxic or clean, that it finds most toxic
itself (the share MOST of them, LEAST at least). A text's score is the softmax of that bag, through a logistic
calibration on rows that the softmax was not trained on.

Training rows are bounded (ROWS of each class by hash order, their whole texts); scoring reads whole texts. Only words
enter a score.

Defined results: null, empty and wordless texts have score 0 and predicted 0; with labels of one class
only (or none) every score is 0; null labels are not learned from, and a row labelled both ways counts
as toxic; repeated rows get equal scores; texts of equal words tie; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid_crf import held_out
from .ngrams import WordTable, batches_of_words, csr, stripped

#: Bound of the training sample: rows of the toxic and the clean class, each read whole.
ROWS = (900, 2700)
BUCKETS, SIZES, DIM = 1 << 18, (3, 4, 5), 16
#: Words of a group in memory, and of a block whose n-grams are hashed at once.
GROUP, BLOCK = 300_000, 20_000
#: Share of a text's words in its bag of most toxic ones, and so many at least.
MOST, LEAST = 0.04, 2
#: Training rows that an n-gram must be in; rows of a minibatch.
LEAST_ROWS, BATCH = 4, 64
#: Adam's rate, scale of the hidden layer, weight decay, most epochs: over whole texts, then over bags of most toxic words; rounds of choosing these.
WHOLE, BAGS, ROUNDS = (0.01, 10.0, 1e-5, 8), (0.003, 1.0, 1e-4, 4), 3
#: An epoch that lowers the loss by less than this share is the last.
GAIN = 0.02


def training_rows(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = ROWS) -> pd.DataFrame:
    """toxic, text of a bounded sample: the first ROWS of each class by hash order, whole."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    there = marked.join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    ids = there.where("toxic = 1").orderBy(*order).limit(rows[0]).unionByName(there.where("toxic = 0").orderBy(*order).limit(rows[1]))
    # At most sum(ROWS) ids: the broadcast is bounded by that parameter.
    got = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return got.orderBy("toxic", *order).select("toxic", "text").toPandas()


class Bags:
    """Bags of words as a sparse matrix: a row holds the weights of its n-grams, each word weighing 1 / words and each of its n-grams an equal part."""

    def __init__(self, bags: list[np.ndarray], starts: np.ndarray, feature: np.ndarray, known: np.ndarray):
        """starts, feature: n-grams by word; known: column of an n-gram, -1 if it isn't learned."""
        counts = np.diff(np.r_[starts, len(feature)])
        columns, weights, sizes = [], [], []
        for b in bags:
            words, times = np.unique(b, return_counts=True)
            n = counts[words]
            at = np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            column, weight = known[feature[at]], np.repeat(times / (n * max(1, len(b))), n)
            live, place = np.unique(column[column >= 0], return_inverse=True)
            columns.append(live.astype(np.int32))
            weights.append(np.bincount(place, weights=weight[column >= 0], minlength=len(live)).astype(np.float32))
            sizes.append(len(live))
        self.columns, self.weights = np.concatenate(columns), np.concatenate(weights)
        self.ends = np.cumsum(sizes)
        self.sizes = np.array(sizes)

    def rows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, weight) of the entries of some rows."""
        n = self.sizes[of]
        at = np.repeat(self.ends[of] - np.cumsum(n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(of)), n), self.columns[at], self.weights[at]


def gradients(emb: np.ndarray, soft: np.ndarray, bias: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], target: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted cross-entropy of a batch, and its gradients by embeddings, softmax and bias. entries: (row, column, weight)."""
    row, column, share = entries
    hidden = np.stack([np.bincount(row, weights=emb[column, j] * share, minlength=len(target)) for j in range(emb.shape[1])], 1)
    q = hidden @ soft + bias
    q = np.exp(q - q.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    at = np.arange(len(target)), target
    loss = -float((weight * np.log(q[at] + 1e-12)).sum())
    q[at] -= 1
    q *= weight[:, None]
    back = q @ soft.T
    d_emb = np.stack([np.bincount(column, weights=back[row, j] * share, minlength=len(emb)) for j in range(emb.shape[1])], 1)
    return loss, d_emb, hidden.T @ q, q.sum(0)


class Net:
    """Embeddings (n-grams x DIM), softmax and bias, started at random."""

    def __init__(self, n: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.emb = self.rng.normal(0, 1 / DIM, (n, DIM)).astype(np.float32)
        self.soft, self.bias = self.rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)

    def logits(self) -> np.ndarray:
        """The softmax's difference by n-gram."""
        return self.emb @ (self.soft[:, 1] - self.soft[:, 0])

    def train(self, bags: Bags, of: np.ndarray, label: np.ndarray, rate: float, scale: float, decay: float, epochs: int) -> None:
        """Minibatch Adam over the rows `of`, the classes weighing alike; ends early when the loss hardly falls."""
        weight = np.where(label == 1, 0.5 / max(1e-9, (label[of] == 1).mean()), 0.5 / max(1e-9, (label[of] == 0).mean()))
        all_ = (self.emb, self.soft, self.bias)
        first, second = [np.zeros_like(x) for x in all_], [np.zeros_like(x) for x in all_]
        step, last = 0, np.inf
        for _ in range(epochs):
            order, total = self.rng.permutation(of), 0.0
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                row, column, share = bags.rows(some)
                live, place = np.unique(column, return_inverse=True)
                loss, d_emb, d_soft, d_bias = gradients(self.emb[live], self.soft, self.bias, (row, place, share * scale), label[some], weight[some] / len(some))
                total += loss * len(some)
                step += 1
                for x, d, m, v, at in zip(all_, (d_emb + decay * self.emb[live], d_soft, d_bias), first, second, (live, slice(None), slice(None)), strict=True):
                    m[at] = 0.9 * m[at] + 0.1 * d
                    v[at] = 0.999 * v[at] + 0.001 * d * d
                    x[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)
            if total > (1 - GAIN) * last:
                break
            last = total


def most_toxic(z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z: word logits of texts of n words each, one text after another -> (place, text) of the words in the bag of each."""
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((-z, text))
    rank = np.arange(len(z)) - np.repeat(np.cumsum(n) - n, n)
    keep = rank < np.minimum(n, np.maximum(LEAST, np.ceil(MOST * n)))[text]
    return order[keep], text[keep]


class Subword:
    """Logits of words from a table of n-gram buckets, and a calibration (slope, offset)."""

    def __init__(self, by_bucket: np.ndarray, bias: float, slope: float, offset: float):
        self.by_bucket, self.bias, self.slope, self.offset = by_bucket, bias, slope, offset

    def words(self, words: list[str]) -> np.ndarray:
        starts, bucket = csr(words, SIZES, BUCKETS)
        counts = np.diff(np.r_[starts, len(bucket)])
        return np.add.reduceat(self.by_bucket[bucket].astype(np.float64), starts) / counts

    def logit(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of texts with words (one at least) of logits z: the softmax of their bags of most toxic words."""
        at, text = most_toxic(z, n)
        return np.bincount(text, weights=z[at]) / np.bincount(text) + self.bias

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (logit - self.offset), -40, 40)))

    @classmethod
    def fit(cls, sample: pd.DataFrame, threshold: float = 0.7, seed: int = 9) -> "Subword | None":
        """Deterministic for a seed. Memory: the sample's words, some 15 n-grams for each different word, and the bags' entries."""
        place: dict[str, int] = {}
        docs, label = [], []
        for t, y in zip(sample["text"], sample["toxic"], strict=True):
            words = [place.setdefault(w, len(place)) for c in t.lower().split() if (w := stripped(c))]
            if words:
                docs.append(np.array(words, dtype=np.int32))
                label.append(int(y))
        if len(set(label)) < 2:
            return None
        label, vocabulary = np.array(label), list(place)
        check = np.zeros(len(label), dtype=bool)  # rows for the calibration: every fourth of a class
        for c in (0, 1):
            check[np.flatnonzero(label == c)[3::4]] = True
        blocks = [csr(vocabulary[k : k + BLOCK], SIZES, BUCKETS) for k in range(0, len(vocabulary), BLOCK)]
        shift = np.cumsum([0] + [len(f) for _, f in blocks])
        starts = np.concatenate([s + d for (s, _), d in zip(blocks, shift[:-1], strict=True)])
        feature = np.concatenate([f.astype(np.int32) for _, f in blocks])
        del blocks, place
        counts = np.diff(np.r_[starts, len(feature)])
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for d, aside in zip(docs, check, strict=True):
            if not aside:
                words = np.unique(d)
                n = counts[words]
                seen[np.unique(feature[np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
        # n-grams of too few rows say nothing about unseen text: they stay at zero
        used = np.flatnonzero(seen >= min(LEAST_ROWS, len(docs)))
        known = np.full(BUCKETS, -1, dtype=np.int32)
        known[used] = np.arange(len(used))
        net, of = Net(len(used), seed), np.flatnonzero(~check)
        net.train(Bags(docs, starts, feature, known), of, label, *WHOLE)
        lengths = np.array([len(d) for d in docs])
        flat = np.concatenate(docs)

        def table() -> np.ndarray:
            out = np.zeros(BUCKETS, dtype=np.float32)
            out[used] = net.logits()
            return out

        def word_logits(by_bucket: np.ndarray) -> np.ndarray:
            return np.add.reduceat(by_bucket[feature], starts) / counts

        for _ in range(ROUNDS):
            at, text = most_toxic(word_logits(table())[flat], lengths)
            bags = np.split(flat[at], np.flatnonzero(np.diff(text)) + 1)
            net.train(Bags(bags, starts, feature, known), of, label, *BAGS)
        model = cls(table(), float(net.bias[1] - net.bias[0]), 1.0, 0.0)
        z = model.logit(word_logits(model.by_bucket)[flat], lengths)
        model.slope, model.offset = _calibrate(z[check], label[check], z[~check], label[~check], threshold)
        return model


def _calibrate(z: np.ndarray, y: np.ndarray, z_fit: np.ndarray, y_fit: np.ndarray, threshold: float) -> tuple[float, float]:
    """Slope and offset that put `threshold` at the cut with the best F1 on the rows set aside, half way over the gap there."""
    if len(set(y.tolist())) < 2:
        z, y = z_fit, y_fit
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    k = int(np.argmax(f1))
    cut = (z[order][k] + z[order][min(k + 1, len(z) - 1)]) / 2
    spread = max(float(np.median(z[y == 1]) - np.median(z[y == 0])), 1e-6)
    slope = 8 / spread
    return slope, float(cut - np.log(threshold / (1 - threshold)) / slope)


def score(docs: DataFrame, model: Subword | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value

        def compute(chunks: list[str]) -> np.ndarray:
            words = [stripped(c) for c in chunks]
            has = np.array([bool(w) for w in words])
            return np.stack([m.words([w or "-" for w in words]), has], 1)

        table = WordTable(compute, 2)
        for pdf in batches:
            out = np.zeros(len(pdf))
            for ids, chunks in batches_of_words(pdf["text"].tolist(), GROUP):
                if not any(chunks):
                    continue
                rows = table.lookup(chunks)
                on = rows[:, 1] > 0
                text = np.repeat(np.arange(len(ids)), [len(c) for c in chunks])[on]
                n = np.bincount(text, minlength=len(ids))
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                out[np.array(ids)[full]] = m.probability(m.logit(rows[on, 0], n[full]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": out})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = 0.7) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted; learned from rows that aren't held out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = Subword.fit(training_rows(d, lab.where(~held_out(F.col("doc_id"), modulus, remainder))), threshold)
    out = score(d, model)
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
