"""Near duplicates among embeddings, by collision counting on one-dimensional projections.

Every vector is scaled to length 1 and projected on Gaussian directions. Two
vectors collide in a projection where their values differ by no more than the
half-width of a window around the query's, WIDE times the distance of the
threshold similarity `least`. A pair at the threshold collides in a projection with
probability erf(WIDE / sqrt 2), so the count that it reaches with probability
COUNT_RECALL follows from the binomial; pairs that reach it are verified by their cosine.

A window of one projection holds about a third of all vectors at least = 0.95, however many
projections are sorted, so windows alone are quadratic. Therefore each of `tables` sorted projections is
sorted within compounds: `depth` further projections cut into cells of CELL threshold distances, with random offsets. depth
grows with the logarithm of the number of vectors, so that a
vector meets about MEET unrelated ones in each cell; tables is what a pair at the
threshold needs to share a cell and a window somewhere with probability DRAW_RECALL. Each vector is a query once: its window
on the sorted projection of its cell gives the pairs whose collisions are counted, on COUNTERS projections. Only
cells, ids and a byte for each counting projection are shuffled (the
window is widened by the rounding), vectors only for pairs to verify.

Classes are components of verified pairs. Equal vectors are one node from the start. Then each node is compared with the least node
of all its cells, so that a group of thousands costs a comparison each, and windows are only searched
between different classes of a cell: what isn't of a cell's largest class against all others. Where that class has more than
CHUNK nodes they are spread over tasks, and the others go to each of these.

Defined results: one row for each id, in classes of one as well; rows with a null id, with a null, empty or zero vector, with nulls,
NaN or infinities in it have no row; vectors of different dimensions are never
alike, each dimension is searched on its own; rows of one id are in one class; a class goes by its least id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.batches import U, lean, mix
from graftwork.llm.components import components
from graftwork.storage import cut, drop

LEAST = 0.95
WIDE, COUNTERS, COUNT_RECALL = 2.0, 32, 0.999
CELL, MEET, DRAW_RECALL = 4.0, 16, 0.98
SEED = 7
#: Nodes of a cell's largest class that one task takes, and pairs that are counted at once.
CHUNK, AT_ONCE = 50_000, 200_000
_STEPS = 16  # steps of a byte to a half-width


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_cell(distance: float, width: float) -> float:
    """Probability that two points at a distance share a cell of a width, with a random offset."""
    t = width / distance
    return 1 - 2 * _phi(-t) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


class Plan:
    """Directions, offsets and counts for so many vectors of a dimension."""

    def __init__(self, dimension: int, vectors: int, least: float = LEAST) -> None:
        near = math.sqrt(max(2 - 2 * least, 1e-6))
        self.width, self.half = CELL * near, WIDE * near
        far, close = same_cell(math.sqrt(2), self.width), same_cell(near, self.width)
        self.depth = max(1, math.ceil(math.log(max(vectors / MEET, 2)) / -math.log(far)))
        p = math.erf(WIDE / math.sqrt(2))
        self.tables = max(1, math.ceil(math.log(1 - DRAW_RECALL) / math.log(1 - p * close**self.depth)))
        tail, self.least_count = 0.0, COUNTERS
        for k in range(COUNTERS, -1, -1):
            tail += math.comb(COUNTERS, k) * p**k * (1 - p) ** (COUNTERS - k)
            self.least_count = k
            if tail >= COUNT_RECALL:
                break
        g = np.random.default_rng(SEED)
        self.direction = g.standard_normal((dimension, self.tables * (self.depth + 1) + COUNTERS)).astype(np.float32)
        self.offset = (g.random(self.tables * self.depth) * self.width).astype(np.float32)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By row and table, cells as hashes and the sorted projections; and the counting projections as bytes that wrap around."""
        p = x @ self.direction
        n, own = len(x), self.tables * self.depth
        cell = np.floor((p[:, :own] + self.offset) / np.float32(self.width)).astype(np.int64).view(U).reshape(n, self.tables, self.depth)
        h = np.broadcast_to(np.arange(1, self.tables + 1, dtype=U) + U(x.shape[1] << 32), (n, self.tables)).copy()
        for d in range(self.depth):
            h = mix((h ^ cell[:, :, d]) * U(0x9E3779B97F4A7C15) + U(d + 1))
        return h, p[:, own : own + self.tables], np.floor(p[:, own + self.tables :] * np.float32(_STEPS / self.half)).astype(np.int64).astype(np.int8)

    def passing(self, place: np.ndarray, codes: np.ndarray, root: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one cell, sorted by place: each query against all rows of other roots in its window that collide with it often enough."""
        # of two queries the later one in the window is the other's partner; what is no query is one either side
        low = queries + 1 if len(queries) == len(place) else np.searchsorted(place, place[queries] - np.float32(self.half), "left")
        size = np.searchsorted(place, place[queries] + np.float32(self.half), "right") - low
        ends, at = np.cumsum(size), 0
        while at < len(queries):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            n = size[at:to]
            i = np.repeat(queries[at:to], n)
            j = np.arange(int(n.sum())) + np.repeat(low[at:to] - (np.cumsum(n) - n), n)
            other = root[i] != root[j]
            i, j = i[other], j[other]
            # int8 differences wrap: only chance collisions are added, none is lost
            good = (np.abs(codes[i] - codes[j]) <= _STEPS + 1).sum(1) >= self.least_count
            yield i[good], j[good]
            at = to


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The valid vectors, scaled, and their rows."""
    ok = [i for i, v in enumerate(column) if v.is_valid and len(v) == dimension and v.values.null_count == 0]
    x = np.array([column[i].values.to_numpy(zero_copy_only=False) for i in ok], np.float64).reshape(len(ok), dimension)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype(np.float32), np.array(ok, np.int64)[good]


def _verify(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """a, b of the pairs of nodes whose cosine is `least` or more."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([v.values.to_numpy(zero_copy_only=False).astype(np.float64) for v in b.column(k)] for k in (2, 3))
            cos = np.array([float(p @ q) / math.sqrt(float(p @ p) * float(q @ q)) if len(p) == len(q) else -1.0 for p, q in zip(x, y)])
            yield b.select(["a", "b"]).filter(pa.array(cos >= least, pa.bool_()))

    joined = pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
    return joined.select("a", "b", "va", "vb").mapInArrow(lean(kernel), "a binary, b binary")


def _across(flat: DataFrame, roots: DataFrame, hot: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """a < b: nodes that collide often enough in a cell and have different roots. hot: the cells of more than CHUNK nodes."""
    kept = "dimension", "cell", "chunk", "node", "root", "big", "place", "codes"
    placed = flat.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = placed.join(hot, "cell", "left_anti").withColumns({"chunk": F.lit(0), "big": F.lit(False)}).select(*kept)
    if hot.limit(1).count():
        large = placed.join(hot, "cell", "left_semi")
        by_root = large.groupBy("cell", "root").agg(F.count("*").alias("n"))
        mixed = by_root.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
        mixed = mixed.select("cell", F.col("most.root").alias("largest"), F.ceil(F.col("most.n") / CHUNK).cast("int").alias("chunks"))
        own = F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int")
        chunk = F.when(F.col("root") == F.col("largest"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
        large = large.join(mixed, "cell").withColumn("chunk", F.explode(chunk)).withColumn("big", F.col("root") == F.col("largest"))
        spread = spread.unionByName(large.select(*kept))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            cell, chunk, place = (t.column(k).to_numpy() for k in ("cell", "chunk", "place"))
            big, dimension = t.column("big").to_numpy(zero_copy_only=False), t.column("dimension").to_numpy()
            node, root = (t.column(k).combine_chunks() for k in ("node", "root"))
            number = root.dictionary_encode().indices.to_numpy()
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(t.num_rows, COUNTERS)
            edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]), [True]]))
            for p, q in zip(edge[:-1].tolist(), edge[1:].tolist()):
                queries = np.flatnonzero(~big[p:q])
                if q - p < 2 or not len(queries) or (number[p:q] == number[p]).all():
                    continue
                for i, j in plans[int(dimension[p])].passing(place[p:q], codes[p:q], number[p:q], queries):
                    if len(i):
                        x, y = (node.take(pa.array(k + p)) for k in (i, j))
                        less = pc.less(x, y)
                        yield pa.RecordBatch.from_arrays([pc.if_else(less, x, y), pc.if_else(less, y, x)], names=["a", "b"])

        held: list[pa.Table] = []  # the last cell's rows, with which the next batch may go on
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            ends = b.column("cell").to_numpy()
            if ends[0] == ends[-1]:
                continue
            whole = pa.concat_tables(held)
            cells = whole.column("cell").to_numpy()
            to = int(np.flatnonzero(cells != cells[-1])[-1]) + 1
            yield from found(whole.slice(0, to))
            held = [whole.slice(to)]
        if held:
            yield from found(pa.concat_tables(held))

    return spread.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "place").mapInArrow(lean(count), "a binary, b binary").distinct()


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """vec_id, class_id (the least id of its class) and members (ids of the class) of each id that has a vector."""
    narrow = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    plans = {r.size: Plan(r.size, r.n, least) for r in narrow.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1))
            for dimension in pc.unique(sizes).to_pylist():
                plan, same = plans[dimension], batch.filter(pc.equal(sizes, dimension))
                for at in range(0, same.num_rows, 2_000):
                    b = same.slice(at, 2_000)
                    x, ok = _matrix(b.column(1), dimension)
                    cells, places, codes = plan.project(x)
                    lists = pa.array(np.arange(0, cells.size + 1, plan.tables), pa.int32())
                    names = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x + np.float32(0)]
                    flat = [pa.ListArray.from_arrays(lists, pa.array(np.ascontiguousarray(y).reshape(-1))) for y in (cells.view(np.int64), places)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), pa.array(names, pa.binary()), pa.array(np.full(len(ok), dimension, np.int32)), *flat, pa.array([r.tobytes() for r in codes], pa.binary()), b.column(1).take(pa.array(ok))], names=["id", "node", "dimension", "cells", "places", "codes", "v"])

    drawn = cut(narrow.mapInArrow(lean(project), "id long, node binary, dimension int, cells array<long>, places array<float>, codes binary, v array<float>"), "projections")
    # of equal vectors one stands for all
    alike = cut(drawn.groupBy("node").agg(F.min("id").alias("id")), "nodes")
    one = drawn.join(alike, ["node", "id"], "left_semi").dropDuplicates(["node"])
    flat = cut(one.select("node", "dimension", "codes", F.explode(F.arrays_zip("cells", "places")).alias("x")).select("node", "dimension", F.col("x.cells").alias("cell"), F.col("x.places").alias("place"), "codes"), "cells")
    nodes = drawn.join(alike, ["node", "id"], "left_semi").select("node", "v").dropDuplicates(["node"])
    # rows of one id are one class
    ids = drawn.select("id", "node").distinct()
    tied = ids.join(ids.groupBy("id").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1"), "id").select(F.col("node").alias("a"), "b")
    hubs = cut(flat.groupBy("cell").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    first = flat.select("cell", "node").join(hubs.select("cell", "hub"), "cell").groupBy("node").agg(F.min("hub").alias("b")).where("b <> node").select(F.col("node").alias("a"), "b")
    edges = cut(_verify(first, nodes, least).union(tied), "edges")
    roots = components(edges)
    more = cut(_verify(cut(_across(flat, roots, hubs.where(F.col("n") > CHUNK).select("cell"), plans), "pairs"), nodes, least), "edges")
    final = components(edges.union(more))
    drop(roots)
    placed = ids.join(final, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    named = placed.groupBy("root").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("members"))
    out = placed.join(named, "root").select(F.col("id").alias("vec_id"), "class_id", "members").distinct()
    result = cut(out, "classes")
    for table in (drawn, alike, flat, hubs, edges, more, final):
        drop(table)
    return result
