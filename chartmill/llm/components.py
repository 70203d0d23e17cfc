"""Connected components of links by least label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """edges (a, b) -> node, label: the least node reachable. labels (node, label): components known before, contracted first.

    A round takes the least label among a node's neighbours, hangs the node's old label under it, and
    follows labels of labels. Nothing leaves the cluster but the count of changed rows.
    """
    if labels is not None:
        la, lb = (labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in ("a", "b"))
        links = edges.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
        found = components(links.distinct())
        moved = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
        old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        return written(old.unionByName(found.join(labels.select("node"), "node", "left_anti")), "components")
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("near"))
        step = state.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        # where a node moves, its old label (a node itself) moves along
        hung = step.where("to < label").groupBy(F.col("label").alias("node")).agg(F.min("to").alias("hung"))
        step = step.join(hung, "node", "left").select("node", "label", F.least("to", F.coalesce("hung", "to")).alias("to"))
        jump = step.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", "label", F.least("to", F.coalesce("next", "to")).alias("to"))
        new = written(jump, "labels")
        changed = new.where("to <> label").limit(1).count()
        state = new.select("node", F.col("to").alias("label"))
        if not changed:
            return state
