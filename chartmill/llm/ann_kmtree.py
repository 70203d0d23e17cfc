"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Inner product becomes Euclidean distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm (0 for queries). The tree is fitted in numpy on a sample (SAMPLE vectors by hash, or SAMPLE_LEAF for each leaf) and
then indexes every row. Leaves aim at LEAF_ROWS rows; beyond MOST_LEAVES their number grows with the square root of the
table, so both the tree, which is broadcast, and a leaf stay small beside it. A query walks it with a priority queue of nodes by distance to their centroid and
visits leaves in the order they come off. How many leaves to visit is calibrated: CALIBRATE queries are
answered by brute force over all rows, and visits widen until their recall reaches TARGET.

Equal vectors are one class with its smallest k + 1 ids (ties go to smaller ids, so no other member can
be in an answer of k): a vector that a third of all rows share is searched once and is one candidate.
Neighbouring leaves form groves of about BLOCK_ROWS classes, to which a query goes once; larger leaves are
split into blocks, each compared with the leaf's queries on its own, QUERY_ROWS of these at a time.

Defined results: null, empty, zero, non-finite vectors and those holding nulls take no part, nor do null ids;
vectors shorter than the longest have zeros beyond their end; rows of one id with different vectors are candidates
each, and that id asks with the least of them; identical rows count once; k or fewer candidates give all of them;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors that the tree is fitted on at least, and for each leaf; children of a node; rows aimed at in a leaf; leaves of a tree before
#: their number follows the table's square root, and that many times this root then.
SAMPLE, SAMPLE_LEAF, BRANCH, LEAF_ROWS, MOST_LEAVES, ROOT = 20_000, 5, 12, 150, 4096, 4
#: Queries that recall is measured on, recall aimed at there, classes in a block of a leaf, queries of a block in one task.
CALIBRATE, TARGET, BLOCK_ROWS, QUERY_ROWS = 160, 0.97, 4000, 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows that take part, each row once, all of one length."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    length, shortest = d.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    if length != shortest:
        kind = dict(d.dtypes)["v"]
        d = d.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(kind[6:-1]), F.lit(length) - F.size("v"))).cast(kind))
    return d


def leaves_for(n: int, leaf_rows: int = LEAF_ROWS) -> int:
    return int(min(max(1, n // leaf_rows), max(MOST_LEAVES, ROOT * n**0.5)))


class Tree:
    """Nodes by number, root 0: children (empty at leaves), centroids, leaf numbers."""

    def __init__(self, most: float):
        self.most, self.children, self.centroids, self.leaf = most, [], [], []

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]])

    @classmethod
    def fit(cls, sample: np.ndarray, n_leaves: int, most: float, seed: int = 0) -> "Tree":
        tree = cls(most)
        x = tree.lifted(sample) if len(sample) else np.zeros((0, 1))
        rng = np.random.default_rng(seed)
        goal = max(4, len(x) // max(1, n_leaves))
        todo = [(tree._node(x.mean(0) if len(x) else np.zeros(x.shape[1])), np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = cls._split(x[rows], min(BRANCH, max(2, round(len(rows) / goal))), rng) if len(rows) > 1.5 * goal else None
            if parts is None:
                continue
            which, centers = parts
            for j, c in enumerate(centers):
                child = tree._node(c)
                tree.children[node].append(child)
                todo.append((child, rows[which == j]))
        leaves = [i for i, c in enumerate(tree.children) if not c]
        tree.leaf = np.full(len(tree.children), -1)
        tree.leaf[leaves] = np.arange(len(leaves))
        tree.centroids = np.array(tree.centroids)
        return tree

    def _node(self, c: np.ndarray) -> int:
        self.children.append([])
        self.centroids.append(c)
        return len(self.children) - 1

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator):
        distinct = np.unique(x, axis=0)
        if len(distinct) < 2:
            return None
        c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(8):
            which = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
            n = np.bincount(which, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, which, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        which = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        live = np.unique(which)
        return (np.searchsorted(live, which), c[live]) if len(live) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number by row: the nearest child at every level."""
        x = self.lifted(x)
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centroids[kids]
            which = ((c * c).sum(1)[None, :] - 2 * x[rows] @ c.T).argmin(1)
            todo += [(kid, rows[which == j]) for j, kid in enumerate(kids) if (which == j).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        q = np.append(q, 0.0)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                yield int(self.leaf[node])
                continue
            d = self.centroids[kids] - q
            for x, kid in zip((d * d).sum(1).tolist(), kids, strict=True):
                heapq.heappush(queue, (x, kid))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, in double precision, summed alike whatever the rows' places."""
    return (a * b).sum(1)


def _best(q: np.ndarray, v: np.ndarray, first: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best candidates, ties to smaller `first`. allowed: queries x candidates."""
    out = []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        rough = part @ v.T
        if allowed is not None:
            rough[~allowed[at : at + 256]] = -np.inf
        if rough.shape[1] > k:
            edge = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
            edge = np.where(np.isfinite(edge), edge - 1e-9 * np.maximum(1.0, np.abs(edge)), -np.finfo(float).max)
        else:
            edge = np.full(len(part), -np.finfo(float).max)
        i, j = np.nonzero(rough >= edge[:, None])
        score = products(part[i], v[j])
        order = np.lexsort((first[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[rank < k] + at, j[rank < k], score[rank < k]))
    if not out:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0)
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def _expanded(q: np.ndarray, v_rows: np.ndarray, scores: np.ndarray, ids: list, classes: np.ndarray) -> pd.DataFrame:
    """Candidate classes as their rows; own: the class is the query's."""
    n = [len(ids[r]) for r in v_rows]
    return pd.DataFrame({"q": np.repeat(q, n), "vec_id": np.array([i for r in v_rows for i in ids[r]], dtype=np.int64), "score": np.repeat(scores, n), "own": np.repeat(q == classes[v_rows], n)})


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 20, k: int = 20, leaf_rows: int = LEAF_ROWS, target: float = TARGET) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score for ids divisible by `every`."""
    spark = vectors.sparkSession
    d = written(usable(vectors).withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64(F.lit(2), "v")).dropDuplicates(["vec_id", "h1", "h2"]), "ann-rows")
    by_id = Window.partitionBy("h1", "h2").orderBy("vec_id")
    least = d.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    classes = least.groupBy("h1", "h2").agg(F.min("vec_id").alias("c"), F.min_by("v", "vec_id").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = d.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by(F.struct("h1", "h2"), "v").alias("h")).select("h.h1", "h.h2", "query_id")
    asks = asked.select("h1", "h2").distinct().withColumn("asks", F.lit(True))
    classes = written(classes.join(asks, ["h1", "h2"], "left").withColumn("asks", F.coalesce("asks", F.lit(False))), "ann-classes")
    n, most = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    leaves = leaves_for(n, leaf_rows)
    wanted = max(SAMPLE, SAMPLE_LEAF * leaves)
    sampled = classes.where(F.pmod(F.xxhash64("h1", "h2", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, wanted / max(1, n)) * (1 << 30))).select("v")
    sample = np.array(sampled.limit(wanted + wanted // 10).toPandas()["v"].tolist(), dtype=float)
    tree = Tree.fit(sample, leaves, float(most or 0.0))
    shared = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["leaf"] = shared.value.assign(np.array(pdf["v"].tolist(), dtype=float))
                yield pdf

    rows = written(classes.select(F.col("h1").alias("h"), "c", "v", "ids", "asks").mapInPandas(index, f"h long, c long, v {dict(classes.dtypes)['v']}, ids array<long>, asks boolean, leaf long"), "ann-index")
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids"))
    size = {r["leaf"]: (r["n"], r["ids"]) for r in sizes.collect()}  # one row a leaf of the tree that the driver holds
    visits = _calibrated(rows, tree, size, k, target)
    place = spark.sparkContext.broadcast(_groves({leaf: n for leaf, (n, _) in size.items()}))
    held = spark.sparkContext.broadcast({leaf: ids for leaf, (_, ids) in size.items()})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = []
            for v in pdf["v"]:
                got, seen, mine = 0, 0, {}
                for leaf in shared.value.walk(np.asarray(v, dtype=float)):
                    if leaf in place.value:
                        grove, blocks = place.value[leaf]
                        for b in range(blocks):
                            mine.setdefault((grove, b), []).append(leaf)
                    got, seen = got + 1, seen + held.value.get(leaf, 0)
                    if got >= visits and seen > k:
                        break
                cells.append([{"grove": g, "block": b, "leaves": x} for (g, b), x in mine.items()])
            yield pd.DataFrame({"q": pdf["h"], "v": pdf["v"], "cells": cells})

    kind = dict(rows.dtypes)["v"]
    queries = rows.where("asks").count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), queries // 2000 + 1)
    routed = rows.where("asks").select("h", "v").repartition(tasks, "h").mapInPandas(route, f"q long, v {kind}, cells array<struct<grove: long, block: long, leaves: array<long>>>")
    routed = written(routed.select("q", "v", F.explode("cells").alias("x")).select("q", "v", "x.grove", "x.block", "x.leaves"), "ann-routed")
    many = routed.groupBy("grove", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts")).where("parts > 1")
    parts = spark.sparkContext.broadcast({(r["grove"], r["block"]): r["parts"] for r in many.collect()})  # at most one row a leaf

    def stow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = [place.value[leaf] for leaf in pdf["leaf"]]
            pdf = pdf.assign(grove=[g for g, _ in at], block=[int(c) % b for c, (_, b) in zip(pdf["c"], at, strict=True)])
            yield pdf.assign(parts=[parts.value.get(x, 1) for x in zip(pdf["grove"], pdf["block"], strict=True)])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(part=[int(q) % parts.value.get((g, b), 1) for q, g, b in zip(pdf["q"], pdf["grove"], pdf["block"], strict=True)])

    stored = rows.select("h", "c", "v", "ids", "leaf").mapInPandas(stow, f"h long, c long, v {kind}, ids array<long>, leaf long, grove long, block long, parts int")
    stored = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    routed = routed.mapInPandas(deal, f"q long, v {kind}, grove long, block long, leaves array<long>, part int")

    def compare(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"q": [], "vec_id": [], "score": [], "own": []}).astype({"q": "int64", "vec_id": "int64", "score": "float64", "own": "bool"})
        leaves, of = np.unique(x["leaf"].to_numpy(), return_inverse=True)
        number = {leaf: i for i, leaf in enumerate(leaves.tolist())}
        asked_here = np.zeros((len(q), len(leaves)), dtype=bool)
        for i, mine in enumerate(q["leaves"]):
            asked_here[i, [number[leaf] for leaf in mine if leaf in number]] = True
        a, b, s = _best(np.array(q["v"].tolist(), dtype=float), np.array(x["v"].tolist(), dtype=float), x["c"].to_numpy(), k + 1, asked_here[:, of])
        return _expanded(q["q"].to_numpy()[a], b, s, x["ids"].tolist(), x["h"].to_numpy())

    found = routed.groupBy("grove", "block", "part").cogroup(stored.groupBy("grove", "block", "part")).applyInPandas(compare, "q long, vec_id long, score double, own boolean")
    answers = _top(found, k + 1).select(F.col("q").alias("h1"), "vec_id", "score", "own")
    out = asked.join(answers, "h1").where(~F.col("own") | (F.col("vec_id") != F.col("query_id")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _groves(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """leaf -> (grove, blocks): neighbouring leaves share a grove of about BLOCK_ROWS rows; a leaf over that is one of its own, in blocks."""
    out, grove, rows = {}, 0, 0
    for leaf in sorted(sizes):
        n = sizes[leaf]
        if rows and rows + n > BLOCK_ROWS:
            grove, rows = grove + 1, 0
        out[leaf] = (grove, max(1, -(-n // BLOCK_ROWS)))
        rows += n
    return out


def _calibrated(rows: DataFrame, tree: Tree, size: dict, k: int, target: float) -> int:
    """Leaves to visit: widened until brute-force answers of sampled queries are found to the share `target`."""
    asked = rows.where("asks").orderBy(F.xxhash64("c", F.lit(5)), "c").limit(CALIBRATE).select("c", "v").collect()
    if not asked or len(size) < 2:
        return 1
    ids, q = np.array([r["c"] for r in asked]), np.array([r["v"] for r in asked], dtype=float)
    sent = rows.sparkSession.sparkContext.broadcast(q)

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b, s = _best(sent.value, np.array(pdf["v"].tolist(), dtype=float), pdf["c"].to_numpy(), k + 1)
                yield pd.DataFrame({"q": a, "vec_id": pdf["c"].to_numpy()[b], "score": s, "leaf": pdf["leaf"].to_numpy()[b], "n": [len(pdf["ids"].iloc[i]) for i in b]})

    got = _top(rows.mapInPandas(brute, "q long, vec_id long, score double, leaf long, n long"), k + 1).toPandas()  # at most CALIBRATE * (k + 1) rows
    place = np.zeros(len(got), dtype=np.int64)
    for i in range(len(ids)):
        mine = np.flatnonzero(got["q"].to_numpy() == i)
        order = {leaf: r for r, leaf in enumerate(tree.walk(q[i]))}
        place[mine] = [order[x] for x in got["leaf"].to_numpy()[mine]]
    visits = 1
    while (place < visits).mean() < target and visits < len(size):
        visits = max(visits + 1, int(visits * 1.25))
    return visits
