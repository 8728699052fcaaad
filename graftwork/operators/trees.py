"""Trees as tables: hash rollups, contexts, intervals, call edges and their transitive callers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftwork.storage import cut

MAX_DEPTH = 5


def rollup_hash(children: DataFrame, parent: str, child_hash: str, own: Column | None = None) -> DataFrame:
    """Hash of a parent's kind and its children's hashes in order of hash; one shuffle on the parent's key."""
    joined = F.concat_ws("", F.array_sort(F.collect_list(child_hash)))
    return children.groupBy(parent).agg(F.count("*").alias("children"), F.md5(joined if own is None else F.concat(own, joined)).alias("hash"))


def context_hash(df: DataFrame, scope: Column, parent_kind: Column, siblings: list[str], order: list[str], depth: int) -> DataFrame:
    """Adds sibling_index and the hash of enclosing scope, parent, ordinal among the siblings and depth."""
    w = Window.partitionBy(*siblings).orderBy(*order)
    df = df.withColumn("sibling_index", F.row_number().over(w).cast("long") - 1)
    return df.withColumn("context_hash", F.md5(F.concat_ws("|", scope, parent_kind, F.col("sibling_index").cast("string"), F.lit(str(depth)))))


def overlapping(spans: DataFrame, windows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows of spans that overlap a window of the same key (half-open); equi join on the key, range as its residual."""
    w = windows.select(F.col(key).alias("_k"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    return spans.join(w, (spans[key] == w["_k"]) & (spans[start] < w["_hi"]) & (spans[end] > w["_lo"]), "left_semi")


def call_edges(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """calls(caller, caller_file, callee, row) resolved to definitions(name, file): an edge for each caller and target, with its first row."""
    d = definitions.select(F.col("name").alias("callee"), F.col("file").alias("callee_file")).distinct()
    return calls.where("caller <> callee").join(d, "callee").groupBy("caller", "caller_file", "callee", "callee_file").agg(F.min("row").alias("row"))


def blast_radius(roots: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, node, depth) for all transitive callers of roots(root) within `depth` calls, by edges(callee, caller).

    Breadth first: each step joins the frontier with the edges and drops pairs
    seen before, so cycles end and a pair has its least depth. Edges and each
    frontier are written tables, so that no step repeats the ones before it.
    """
    edges = cut(edges.select("callee", "caller").distinct(), "call-edges")
    seen = [cut(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth")), "frontier")]
    frontier = seen[0]
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["callee"]).select("root", F.col("caller").alias("node")).distinct()
        before = reduce(DataFrame.union, seen).select("root", "node")
        frontier = cut(step.join(before, ["root", "node"], "left_anti").withColumn("depth", F.lit(d).cast("long")), "frontier")
        seen.append(frontier)
    return reduce(DataFrame.union, seen[1:])


def severity(callers: Column) -> Column:
    return F.when(callers >= 5, "HIGH").when(callers > 0, "MEDIUM").otherwise("LOW")
