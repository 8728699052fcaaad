"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text's shingles are its runs of three words (a shorter text is one shingle),
weighted by their count in it and by idf = ln(documents / documents with the
shingle), LEAST_IDF at least. All shingles of all documents are counted, in a count-min sketch of
ROWS rows of WIDTH counters that is summed by a shuffle: it is of one size for any corpus. A count is never too low; it is too high by
e / WIDTH of all shingles, or e * (shingles a text) / WIDTH of the documents, with a probability of at most e ** -ROWS. So documents of
500 shingles have idf told apart down to shares of about 0.0003 (as expected, 0.0001) at every size, and a corpus of some thousand texts has it exactly.

Texts of equal words are one node from then on. A node's sketch takes BANDS * DEPTH consistent
weighted samples (the probability that two nodes share one is their weighted
Jaccard similarity); nodes that share all DEPTH samples of a band are
candidates. Verification comes in rounds, each of which cuts what remains: every
node against the least node of all its bands' buckets; then, between
different components, the least nodes of each in a bucket; then all pairs of
nodes that share a bucket but, still, no component. So no pair of candidates goes
unexamined unless its nodes are already in one group, and a group of thousands
of copies costs a comparison each, not one a pair.

A group is a connected component of verified pairs (similarity >= `least`); its
row of least id stays (null ids last, then the least hash of the text).

Defined results: null and empty texts, and texts without words, are in no group
and stay; rows equal in id and text are one row of which one stays; texts of
any length are taken whole; ties go to the least id. Other columns are ignored,
and kept by deduplicate().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm import rows
from graftwork.llm.batches import U, Words, grams, lean, mix, slices
from graftwork.llm.components import components, joined
from graftwork.storage import cut, drop

WORDS, BANDS, DEPTH, LEAST = 3, 20, 3, 0.5
LEAST_IDF = 0.05
ROWS, WIDTH = 2, 1 << 22
SEED = 20240229
_FEATURE_BITS = 44
_TABLE_BITS = 12
#: Shingles that are added to a sketch at once, and the parts in which sketches are summed.
BLOCK_SHINGLES, PARTS = 1_000_000, 64
#: Shingles whose samples are drawn at once.
DRAW = 20_000


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each row as 44-bit features, ordered by row: features, counts, first[i]:first[i + 1]."""
    hashes, begin = grams(words.hash, words.first, WORDS)
    n = len(begin) - 1
    out_f, out_c, sizes = [], [], []
    # the row takes the 20 bits above the feature's
    for low in range(0, n, 1 << 20):
        high = min(n, low + (1 << 20))
        a, b = int(begin[low]), int(begin[high])
        row = np.repeat(np.arange(high - low).astype(U), np.diff(begin[low : high + 1]))
        key = (row << U(_FEATURE_BITS)) | (hashes[a:b] >> U(64 - _FEATURE_BITS))
        key.sort()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        out_c.append(np.diff(np.append(start, len(key))))
        key = key[start]
        out_f.append(key & U((1 << _FEATURE_BITS) - 1))
        sizes.append(np.bincount((key >> U(_FEATURE_BITS)).astype(np.int64), minlength=high - low))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(out_f or [np.zeros(0, U)]), np.concatenate(out_c or [np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum(size)])


def _cells(features: np.ndarray) -> list[np.ndarray]:
    """Of each row of the sketch, the features' counters."""
    h = mix(features)
    return [(h >> U(32 * k)).astype(np.int64) & (WIDTH - 1) for k in range(ROWS)]


class Idf:
    """Inverse document frequencies from the logarithms of a sketch's counts, [ROWS, WIDTH]."""

    def __init__(self, counts: np.ndarray, documents: int) -> None:
        self.counts, self.most = counts, np.float32(np.log(max(documents, 2)))

    def weights(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        seen = np.min([row[at] for row, at in zip(self.counts, _cells(features))], 0).astype(np.float32)
        return np.maximum(self.most - seen, np.float32(LEAST_IDF)) * counts.astype(np.float32)


def frequencies(docs: DataFrame, text_col: str = "text") -> Idf:
    """The idf of all shingles over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, docs, size, held = np.zeros((ROWS, WIDTH), np.uint32), 0, 0, []

        def add() -> None:
            nonlocal size, held
            for row, at in zip(sketch, _cells(np.concatenate(held))):
                row += np.bincount(at, minlength=WIDTH).astype(np.uint32)
            size, held = 0, []

        for batch in batches:
            for b in slices(batch):
                f = shingles(Words(b.column(0)))[0]
                docs, size = docs + b.num_rows, size + len(f)
                held.append(f)
                if size >= BLOCK_SHINGLES:
                    add()
        if held:
            add()
            pack = zstandard.ZstdCompressor(level=1)
            # bytes of equal weight together, as nearly all of the higher ones are 0
            parts = [pack.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()) for x in np.split(sketch.reshape(-1), PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([docs] + [0] * (PARTS - 1), pa.int64()), pa.array(parts, pa.binary())], names=["part", "docs", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        docs, unpack = 0, zstandard.ZstdDecompressor()
        for b in batches:
            docs += sum(b.column(1).to_pylist())
            for part, x in zip(b.column(0).to_pylist(), b.column(2)):
                own = np.ascontiguousarray(np.frombuffer(unpack.decompress(x.as_buffer()), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
                if part in total:
                    total[part] += own
                else:
                    total[part] = own.astype(np.uint64)
        for k, (part, x) in enumerate(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs * (k == 0)], pa.int64()), pa.array([np.log(np.maximum(x, 1)).astype(np.float16).tobytes()], pa.binary())], names=["part", "docs", "counts"])

    schema = "part int, docs long, counts binary"
    text = docs.select(docs[text_col].cast("string").alias("text"))
    found = text.mapInArrow(lean(count), schema).repartition(PARTS, "part").mapInArrow(lean(add_up), schema)
    counts, total = np.zeros((PARTS, ROWS * WIDTH // PARTS), np.float16), 0
    for r in found.toLocalIterator():
        counts[r.part] = np.frombuffer(r.counts, np.float16)
        total += r.docs
    return Idf(counts.reshape(ROWS, WIDTH), total)


class Sampler:
    """Consistent weighted samples: per feature and sample r and c ~ Gamma(2, 1) and b ~ U(0, 1), each from its own bits of the feature."""

    def __init__(self, samples: int = BANDS * DEPTH, seed: int = SEED) -> None:
        g, shape = np.random.default_rng(seed), (1 << _TABLE_BITS, samples)
        self.r = g.gamma(2.0, 1.0, shape).astype(np.float32)
        self.ln_c = np.log(g.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.b = g.random(shape).astype(np.float32)
        self.samples = samples

    def _draw(self, features: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = U((1 << _TABLE_BITS) - 1)
        h = mix(features)
        i, j, k = ((h >> U(s)) & mask for s in (0, _TABLE_BITS, 2 * _TABLE_BITS))
        r, b = self.r[i.astype(np.int64)], self.b[k.astype(np.int64)]
        t = np.divide(ln_w[:, None], r)
        t += b
        np.floor(t, out=t)
        a = np.subtract(t, b, out=b)
        a += np.float32(1)
        a *= r
        return np.subtract(self.ln_c[j.astype(np.int64)], a, out=a), t

    def sketch(self, features: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """By row and sample: a 64-bit hash of the feature drawn and its level; rows without features have 0."""
        n = len(first) - 1
        out = np.zeros((n, self.samples), U)
        ln_w = np.log(weights)
        row, cols = 0, np.arange(self.samples)
        while row < n:
            to = max(row + 1, int(np.searchsorted(first, first[row] + DRAW, "right")) - 1)
            a, z = int(first[row]), int(first[to])
            if to == row + 1:  # one long text, piece by piece
                low = np.full(self.samples, np.inf, np.float32)
                for p in range(a, z, DRAW):
                    q = min(z, p + DRAW)
                    value, level = self._draw(features[p:q], ln_w[p:q])
                    at = value.argmin(0)
                    best = value[at, cols]
                    better = best < low
                    low[better] = best[better]
                    out[row, better] = self._name(features[p:q][at], level[at, cols])[better]
            else:
                value, level = self._draw(features[a:z], ln_w[a:z])
                for i in range(row, to):
                    p, q = int(first[i]) - a, int(first[i + 1]) - a
                    if q > p:
                        at = value[p:q].argmin(0) + p
                        out[i] = self._name(features[a + at], level[at, cols])
            row = to
        return out

    @staticmethod
    def _name(features: np.ndarray, level: np.ndarray) -> np.ndarray:
        return mix((features << U(20)) ^ (level.astype(np.int64).view(U) & U(0xFFFFF)))


def bands(samples: np.ndarray) -> np.ndarray:
    out = np.zeros((len(samples), BANDS), U)
    for band in range(BANDS):
        h = np.full(len(samples), U(band + 1))
        for d in range(DEPTH):
            h = mix((h ^ samples[:, band * DEPTH + d]) * U(0x9E3779B97F4A7C15))
        out[:, band] = h
    return out


def _content(words: Words) -> list[bytes | None]:
    """128 bits of each row's words in order; None where there are none."""
    place = (np.arange(len(words.hash)) - words.first[:-1][words.row]).astype(U)
    sums = []
    for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        run = np.concatenate([np.zeros(1, U), np.cumsum(mix(words.hash + place * U(k)), dtype=U)])
        sums.append(mix(run[words.first[1:]] - run[words.first[:-1]]))
    raw = np.stack(sums, 1).tobytes()
    return [raw[16 * i : 16 * i + 16] if c else None for i, c in enumerate(np.diff(words.first).tolist())]


def sketches(docs: DataFrame, idf: Idf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_id, key_text, node (the content) and bands of each row that has words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for batch in batches:
            for b in slices(batch):
                words = Words(b.column(2))
                features, counts, first = shingles(words)
                found = bands(sampler.sketch(features, idf.weights(features, counts), first))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS), pa.int32()), pa.array(found.reshape(-1).view(np.int64)))
                out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_content(words), pa.binary()), flat], names=["key_id", "key_text", "node", "bands"])
                yield out.filter(out.column(2).is_valid())

    return rows.keyed(docs, id_col, text_col).mapInArrow(lean(kernel), "key_id long, key_text long, node binary, bands array<long>")


def _vectors(docs: DataFrame, wanted: DataFrame, count: int, idf: Idf, id_col: str, text_col: str) -> DataFrame:
    """node, features and weights of the wanted(key_id, key_text, node)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                features, counts, first = shingles(Words(b.column(1)))
                weights = idf.weights(features, counts)
                at = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(features.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(weights))], names=["node", "features", "weights"])

    wanted = F.broadcast(wanted) if count <= rows.BROADCAST_KEYS else wanted
    some = rows.keyed(docs, id_col, text_col).join(wanted, ["key_id", "key_text"]).dropDuplicates(["node"]).select("node", "text")
    return some.mapInArrow(lean(kernel), "node binary, features array<long>, weights array<float>")


def weighted_jaccard(fa: np.ndarray, wa: np.ndarray, fb: np.ndarray, wb: np.ndarray) -> float:
    """Of two vectors with sorted, distinct features."""
    at = np.minimum(np.searchsorted(fb, fa), len(fb) - 1)
    same = fb[at] == fa
    shared = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return shared / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - shared)


def _verify(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """a, b and similarity of the pairs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for i in (2, 3, 4, 5):
                c = b.column(i)
                parts.append((c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)))
            out = []
            for i in range(b.num_rows):
                fa, wa, fb, wb = (v[o[i] : o[i + 1]] for o, v in parts)
                out.append(weighted_jaccard(fa, wa, fb, wb))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    left = vectors.select(F.col("node").alias("a"), F.col("features").alias("fa"), F.col("weights").alias("wa"))
    right = vectors.select(F.col("node").alias("b"), F.col("features").alias("fb"), F.col("weights").alias("wb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "wa", "fb", "wb")
    return joined.mapInArrow(lean(kernel), "a binary, b binary, similarity double")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """key_id, key_text, keep_id, keep_text and copies (equal rows) of each distinct row in a group of two rows or more."""
    idf = frequencies(docs, text_col)
    found = cut(sketches(docs, idf, id_col, text_col), "sketches")
    order = F.struct((F.col("key_id") == rows._NO_ID).alias("no_id"), "key_id", "key_text")
    nodes = cut(found.groupBy("node").agg(F.min(order).alias("least"), F.first("bands").alias("bands")), "nodes")
    flat = nodes.select("node", F.explode("bands").alias("band"))
    # counts of a bucket are partial before the shuffle, and the join splits a large one
    hubs = flat.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    members = cut(flat.join(hubs, "band").select("band", "node", "hub"), "buckets")
    wanted = nodes.select("least.key_id", "least.key_text", "node").join(members.select("node").distinct(), "node")
    vectors = cut(_vectors(docs, wanted, wanted.count(), idf, id_col, text_col), "vectors")

    # each node against the least of its hubs
    pairs = members.groupBy("node").agg(F.min("hub").alias("b")).where("b <> node").select(F.col("node").alias("a"), "b")
    checked = [cut(_verify(pairs, vectors), "verified")]
    roots = components(checked[0].where(F.col("similarity") >= least))
    # between components, the least nodes of each in a bucket; then all nodes
    for everything in (False, True):
        places = members.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        places = cut(places, "places")
        span = places.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "lo")
        mixed = places.join(span, "band")
        if not everything:
            mixed = mixed.groupBy("band", "root").agg(F.min("node").alias("node"), F.first("lo").alias("lo"))
        mixed = cut(mixed.select("band", "node", "root", "lo"), "mixed")
        other = mixed.select(F.col("band").alias("of"), F.col("node").alias("b"), F.col("root").alias("root_b"))
        wide = mixed if everything else mixed.where("root = lo")
        pairs = wide.join(other, (wide.band == other.of) & ((wide.root < other.root_b) if everything else (other.root_b != wide.root)))
        pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        for before in checked:
            pairs = pairs.join(before.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        checked.append(cut(_verify(pairs, vectors), "verified"))
        fresh = joined(roots, checked[-1].where(F.col("similarity") >= least))
        for table in (roots, places, mixed):
            drop(table)
        roots = fresh

    whole = found.select("key_id", "key_text", "node").join(roots, "node", "left").select("key_id", "key_text", F.coalesce("root", "node").alias("root"))
    alike = whole.groupBy("root", "key_id", "key_text").agg(F.count("*").alias("copies"))
    kept = alike.groupBy("root").agg(F.min(order).alias("keep"), F.sum("copies").alias("rows")).where("rows > 1").select("root", "keep")
    out = cut(alike.join(kept, "root").select("key_id", "key_text", F.col("keep.key_id").alias("keep_id"), F.col("keep.key_text").alias("keep_text"), "copies"), "groups")
    for table in (found, nodes, members, vectors, roots, *checked):
        drop(table)
    return out


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id and duplicate_of (the id that stays) of every row that is a duplicate of another, once for each such row."""
    found = groups(docs, **options)
    stays = (F.col("key_id") == F.col("keep_id")) & (F.col("key_text") == F.col("keep_text"))
    times = F.col("copies") - F.when(stays, 1).otherwise(0)
    found = found.withColumn("times", times).where("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return found.select(rows.id_of(F.col("key_id")).alias("doc_id"), rows.id_of(F.col("keep_id")).alias("duplicate_of"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, as they are, without all but one of each group."""
    found = groups(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where("key_id <> keep_id OR key_text <> keep_text").select("key_id", "key_text")
    twice = found.where("key_id = keep_id AND key_text = keep_text AND copies > 1").select("key_id", "key_text")
    left = rows.without(docs, gone, gone.count(), id_col, text_col)
    repeated = twice.count()
    if not repeated:
        return left
    # rows equal in id and text: one of them
    once = rows.within(left, twice, repeated, id_col, text_col).dropDuplicates([id_col, text_col])
    return rows.without(left, twice, repeated, id_col, text_col).unionByName(once)
