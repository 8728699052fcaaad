"""Language identification: an interpolated Kneser-Ney character model for each language.

Each model is trained on a bounded sample of labelled rows (at most
`train_docs` of each language, those with the smallest hash of id and text),
and its threshold is calibrated on as many other rows. Texts are lower-cased;
white space counts as one kind of symbol, digits as another, and every other character of any
script as itself; the lowest order is interpolated with one share for each symbol of the sample and one for all others.

The n-grams of a model lie in arrays sorted by a 64-bit hash, one for each
order, with their interpolated log-probability, and contexts likewise with
their back-off weight. Before scoring, the models' arrays are merged into one
sorted array for each order with a value for each language, in which whatever a
language lacks is already resolved by its own back-off: so a character costs
one search however many languages there are.

The language of the lowest cross-entropy per character wins, the first by name
of equals. It is rejected where the cross-entropy is further above what
held-out rows of that language have at such a length (mean, and variance a +
b / characters) than all but `false_rejects` of them and at least `least_z`
standard deviations.

Defined results: null and empty texts have no language and are rejected (bits
null); texts of any length are scored whole; repeated rows are scored each; where no row
is labelled there is no model, and every text that isn't empty is accepted with a null language.
Unlabelled rows (null lang) take no part in training. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftwork.llm.batches import U, lean, mix, raw, slices
from graftwork.llm.rows import BROADCAST_KEYS
from graftwork.storage import cut

ORDER = 5
TRAIN_DOCS = 400
FALSE_REJECTS = 0.001
LEAST_Z = 5.0
#: Bytes of text that are scored at once: each takes some hundred of memory.
_SLICE = 500_000


class HashArray:
    """Sorted 64-bit hashes of keys, with an index on their leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        h = mix(keys.astype(U))
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.shift = 64 - max(6, int(len(keys)).bit_length())
        self.first = np.searchsorted(self.hashes, np.arange((1 << (64 - self.shift)) + 1).astype(U) << U(self.shift)).astype(np.int32)
        self.first[-1] = len(keys)

    @staticmethod
    def of(state: dict) -> HashArray:
        out = HashArray.__new__(HashArray)
        out.__dict__.update(state)
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is, -1 if nowhere."""
        h = mix(keys)
        bucket = (h >> U(self.shift)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(h), -1, np.int32)
        if not len(self.hashes):
            return out
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
        out[hit] = at[hit]
        left = np.flatnonzero(~hit & (at + 1 < end))
        while len(left):
            at[left] += 1
            here = at[left]
            hit = self.hashes[here] == h[left]
            out[left[hit]] = here[hit]
            left = left[~hit & (here + 1 < end[left])]
        return out


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Of each character of the basic plane, itself, but one for white space and one for digits."""
    table = np.arange(0x10000, dtype=np.uint32)
    for c in (*range(9, 14), 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x3000):
        table[c] = 32
    table[48:58] = 48
    return table


def symbols_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, and how many each has."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    points = np.frombuffer(raw(low)[0].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return np.where(points < 0x10000, _symbols()[np.minimum(points, 0xFFFF)], points), pc.utf8_length(low).to_numpy().astype(np.int64)


class Grams:
    """The n-grams of some texts, by the character they end with; and the characters of each text. 0 pads the start of a text."""

    def __init__(self, texts: pa.Array) -> None:
        (points, self.count), pad = symbols_of(texts), ORDER - 1
        self.place = np.arange(len(points)) + pad * (np.repeat(np.arange(len(self.count)), self.count) + 1)
        self.line = np.zeros(len(points) + pad * (len(self.count) + 1), np.uint32)
        self.line[self.place] = points

    def keys(self, k: int, rows: np.ndarray | slice = slice(None), back: int = 0) -> np.ndarray:
        """Of each character, or some, the hash of the k symbols that end with it, or with the one `back` before it."""
        at = self.place[rows] - back
        key = np.zeros(len(at), U)
        for j in range(k):
            key = mix(key * U(0x9E3779B97F4A7C15) + self.line[at - j].astype(U) + U((j + 1) << 32))
        return key


def kneser_ney(g: Grams, base: float) -> tuple[list[tuple[np.ndarray, ...]], list[tuple[np.ndarray, np.ndarray]]]:
    """By order, from 1: sorted keys, log2-probabilities, suffixes and contexts of the n-grams; and sorted contexts and log2 back-off weights. base: the share of a symbol below all orders."""
    _, at, count = np.unique(g.keys(ORDER), return_index=True, return_counts=True)
    by_order = {ORDER: (at, count)}
    for k in range(ORDER - 1, 0, -1):
        above = by_order[k + 1][0]
        _, first, count = np.unique(g.keys(k, above), return_index=True, return_counts=True)
        by_order[k] = above[first], count
    grams, contexts = [], []
    for k in range(1, ORDER + 1):
        at, c = by_order[k]
        key, suffix, around = g.keys(k, at), g.keys(k - 1, at), g.keys(k - 1, at, 1)
        ones, twos = int((c == 1).sum()), int((c == 2).sum())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        h, inverse, types = np.unique(around, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=c)
        weight = d * types / total
        lower = base if k == 1 else np.exp2(grams[-1][1][np.searchsorted(grams[-1][0], suffix)])
        grams.append((key, np.log2((c - d) / total[inverse] + weight[inverse] * lower), suffix, around))
        contexts.append((h, np.log2(weight)))
    return grams, contexts


class Models:
    """The models of all languages, merged for scoring; thresholds after calibrate()."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.langs = sorted(texts)
        every = [pa.array(texts[x], pa.large_string()) for x in self.langs]
        base = 1 / (len(np.unique(np.concatenate([np.unique(symbols_of(t)[0]) for t in every]))) + 1)
        own = [kneser_ney(Grams(t), base) for t in every]  # one after the other: each takes a hundred bytes a character
        self.base = np.full((1, len(own)), np.log2(base), np.float32)
        below_keys, below = np.zeros(1, U), np.full((1, len(own)), np.log2(base))
        self.grams: list[tuple[HashArray, np.ndarray]] = []
        self.contexts: list[tuple[HashArray, np.ndarray]] = []
        for k in range(ORDER):
            union, at = np.unique(np.concatenate([g[k][0] for g, _ in own]), return_index=True)
            suffix, context = (np.concatenate([g[k][i] for g, _ in own])[at] for i in (2, 3))
            around = np.unique(np.concatenate([c[k][0] for _, c in own]))
            back = np.zeros((len(around), len(own)))
            for j, (_, c) in enumerate(own):
                back[np.searchsorted(around, c[k][0]), j] = c[k][1]
            value = back[np.searchsorted(around, context)] + below[np.searchsorted(below_keys, suffix)]
            for j, (g, _) in enumerate(own):
                value[np.searchsorted(union, g[k][0]), j] = g[k][1]
            below_keys, below = union, value
            for to, key, v in ((self.grams, union, value), (self.contexts, around, back)):
                hashed = HashArray(key)
                to.append((hashed, np.ascontiguousarray(v[hashed.order].astype(np.float32))))
                del hashed.order
        self.fit: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, np.inf)] * len(own)

    def _score(self, g: Grams, k: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        if k == 0:
            return self.base
        table, value = self.grams[k - 1]
        at = table.find(g.keys(k, rows))
        out = value[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            some = missing if isinstance(rows, slice) else rows[missing]
            rest = self._score(g, k - 1, some)
            table, value = self.contexts[k - 1]
            at = table.find(g.keys(k - 1, some, 1))
            out[missing] = rest + np.where((at >= 0)[:, None], value[at], np.float32(0))
        return out

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per character, by text and language; and each text's characters."""
        g = Grams(texts)
        count = g.count
        out = np.full((len(count), len(self.langs)), np.nan)
        full = np.flatnonzero(count)
        if len(full):
            score, begin = self._score(g, ORDER), (np.cumsum(count) - count)[full]
            for j in range(len(self.langs)):
                out[full, j] = -np.add.reduceat(score[:, j].astype(np.float64), begin) / count[full]
        return out, count

    def calibrate(self, texts: dict[str, list[str]], false_rejects: float, least_z: float) -> None:
        for j, lang in enumerate(self.langs):
            held = pa.RecordBatch.from_arrays([pa.array([t for t in texts.get(lang, []) if t], pa.large_string())], names=["text"])
            parts = [self.bits(b.column(0)) for b in slices(held, most=_SLICE)] or [(np.zeros((0, len(self.langs))), np.zeros(0))]
            own, n = np.concatenate([p[0][:, j] for p in parts]), np.maximum(np.concatenate([p[1] for p in parts]), 1)
            if len(own) < 8:  # too few to tell: nothing is rejected
                continue
            mean = float(np.median(own))
            square = (own - mean) ** 2
            a, b = np.linalg.lstsq(np.stack([np.ones(len(n)), 1 / n], 1), square, rcond=None)[0]
            a, b = max(a, 1e-3), max(b, 10.0)
            z = (own - mean) / np.sqrt(a + b / n)
            self.fit[j] = (mean, float(a), float(b), max(least_z, float(np.quantile(z, 1 - false_rejects))))

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: the best language's number, its bits per character, whether it is accepted."""
        bits, count = self.bits(texts)
        best = np.where(np.isnan(bits[:, 0]), 0, np.argmin(np.nan_to_num(bits, nan=np.inf), 1))
        low = bits[np.arange(len(best)), best]
        mean, a, b, z = (np.array([f[i] for f in self.fit])[best] for i in range(4))
        with np.errstate(invalid="ignore"):
            return best, low, (count > 0) & ((low - mean) <= z * np.sqrt(a + b / np.maximum(count, 1)))


def sample(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """At most so many labelled rows of each language, those of the smallest hash: lang, r (rank), text."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").withColumn("h", F.xxhash64("id", "text"))
    ranked = docs.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= most)
    chosen = cut(ranked.groupBy("lang", "h").agg(F.min("r").alias("r")), "sample")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen
    return docs.join(few, ["lang", "h"]).select("lang", "r", "text").dropDuplicates(["lang", "r"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, false_rejects: float = FALSE_REJECTS, least_z: float = LEAST_Z, **names: str) -> Models | None:
    """Fits the models in one task."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["lang"], r["r"], r["text"]) for b in batches for r in b.to_pylist())
        odd: dict[str, list[str]] = {}
        even: dict[str, list[str]] = {}
        for i, (lang, _, text) in enumerate(rows):
            (odd if i % 2 else even).setdefault(lang, []).append(text)
        for lang in {*odd} - {*even}:
            even[lang] = odd[lang]
        if even:
            models = Models(even)
            models.calibrate(odd, false_rejects, least_z)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([models.langs, models.base, models.fit, *([(t.__dict__, v) for t, v in x] for x in (models.grams, models.contexts))])], pa.large_binary()).cast(pa.binary())], names=["models"])

    found = sample(docs, 2 * train_docs, **names).repartition(1).mapInArrow(lean(fit), "models binary").collect()
    if not found:
        return None
    models = Models.__new__(Models)
    models.langs, models.base, models.fit, *both = pickle.loads(found[0].models)
    models.grams, models.contexts = ([(HashArray.of(t), v) for t, v in x] for x in both)
    return models


def identify(docs: DataFrame, models: Models | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: float) -> DataFrame:
    """doc_id, predicted language (null if rejected), nearest language, bits per character, whether accepted: for each row."""
    models = models or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=_SLICE):
                n = b.num_rows
                if models is None:
                    ok = np.array([bool(v.as_py()) for v in b.column(1)], bool)
                    near, bits = pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())
                else:
                    best, low, ok = models.decide(b.column(1))
                    near = pa.array([models.langs[i] for i in best], pa.string(), mask=np.isnan(low))
                    bits = pa.array(low, pa.float64(), mask=np.isnan(low))
                predicted = pc.if_else(pa.array(ok), near, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), predicted, near, bits, pa.array(ok)], names=["doc_id", "predicted", "nearest", "bits_per_char", "accepted"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(kernel), "doc_id long, predicted string, nearest string, bits_per_char double, accepted boolean")


def keep_identified(docs: DataFrame, text_col: str = "text", models: Models | None = None, **options: float) -> DataFrame:
    """The rows whose language is accepted, as they are."""
    models = models or train(docs, text_col=text_col, **options)
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text_col, _SLICE):
                ok = [bool(v.as_py()) for v in b.column(at)] if models is None else models.decide(b.column(at))[2]
                yield b.filter(pa.array(ok))

    return docs.mapInArrow(lean(kernel), docs.schema)
