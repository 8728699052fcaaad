"""Connected components of edges, by label propagation with pointer jumping; each round's labels are a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.storage import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """node and root (the component's least node) for every node of edges(a, b). Labels only fall, so the rounds end."""
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("low"))
        lower = labels.join(around, labels.node == around.a).select("node", F.col("root").alias("was"), F.least("root", "low").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("over"))
        fresh = lower.join(jump, lower.low == jump["at"], "left").select("node", "was", F.least("low", "over").alias("root"))
        fresh = cut(fresh, "labels")
        changed = fresh.where("root <> was").limit(1).count()
        drop(labels)
        labels = fresh.select("node", "root")
        if not changed:
            drop(both)
            return labels


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The roots of components(), with further edges(a, b): only what the edges join is gone through again."""
    a, b = (roots.select(F.col("node").alias(k), F.col("root").alias("root_" + k)) for k in ("a", "b"))
    fresh = cut(edges.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b")), "edges")
    over = components(fresh.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    # nodes that had no root are their own
    new = fresh.select(F.col("a").alias("node")).union(fresh.select("b")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    every = roots.select("node", "root").union(new)
    out = cut(every.join(over.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root")), "labels")
    drop(fresh)
    drop(over)
    return out
