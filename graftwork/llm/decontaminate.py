"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows of the templates are hash-joined.

A text's words are canonicalised: a number (digits, or a number word; several in a row are one) is
<number>, a unit of measure right after a number is <unit>, a name (a
capitalised word, or several in a row, that doesn't begin a sentence and isn't
all capitals) is <name>; all else is the word itself in lower case. All windows
of `window` such tokens of the benchmark's items are hashed (an item of fewer
tokens is one window of its own length), and so are those of all documents. Windows that an item begins with a capitalised
word are hashed with a name in its place as well, as it reads within a sentence.
A document's windows are shuffled only where a Bloom filter of the items' windows, sized
by their number, lets them pass; then they are joined by hash.

A window with less than half literal words, or of an item of fewer than LEAST tokens, is hashed with the values of its slots, so it matches exact copies only.

Windows that match with the same shift between document and item form one
alignment. In it the slots must agree: equal values of the item stand against
equal values of the document and different against different. So a
question with other numbers, names or units, used alike throughout, is caught, and a
text that only shares phrasing is not. Words put in or left out begin a new shift: alignments whose shifts
are at most NEAR tokens from the next are joined, the longest first, each if its slots agree with those before.
A document is contaminated by an item where what is joined covers at least `cover` of the item's tokens, or ENOUGH tokens.

Defined results: null and empty texts of either table match nothing; items
of fewer than LEAST tokens and fewer than EXACT words (which any text may hold by chance) are not
searched for; of items that cover a text equally each is reported; texts of any length are searched whole; repeated documents are
each reported once for each item (rows of equal id and text are one); repeated items are
reported under each id; a null doc_id is reported as null. Other columns are ignored, and kept by decontaminate().
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm import rows
from graftwork.llm.batches import U, Words, lean, mix, raw, slices
from graftwork.storage import cut

WINDOW, LEAST, EXACT, COVER, ENOUGH, NEAR = 8, 5, 4, 0.5, 24, 4
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp degree degrees celsius fahrenheit kelvin mph kmh kph hz khz mhz ghz w kw mw watt watts v volt volts amp amps joule joules calorie calories byte bytes kb mb gb tb".split()
LITERAL, NUMBER, UNIT, NAME = range(4)
_DENSE = U(0x3C6EF372FE94F82B)
_SLOT = np.array([0, 0x51ED270B1, 0x7A2B3C4D5, 0x19F8E7D6C], U)


def _set(words: list[str]) -> np.ndarray:
    return np.sort(Words(pa.array(words)).hash)


def _among(values: np.ndarray, those: np.ndarray) -> np.ndarray:
    return those[np.minimum(np.searchsorted(those, values), len(those) - 1)] == values


class Templates:
    """Tokens of the templates of some texts: hash, kind, value, row; first[i]:first[i + 1] are row i's."""

    def __init__(self, texts: pa.Array, numbers: np.ndarray, units: np.ndarray) -> None:
        w = Words(texts)
        data, n = w.data, len(w.start)
        # lower case goes by character, so the n-th of both texts belong together, whatever their lengths in bytes
        high, low = (np.frombuffer(x.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32) for x in (raw(texts)[0], data))
        pad = np.concatenate([data, np.zeros(8, np.uint8)])
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        differs = np.concatenate([(high != low)[character], np.zeros(8, bool)])
        wide = np.where(pad[w.start] >= 0xF0, 4, np.where(pad[w.start] >= 0xE0, 3, np.where(pad[w.start] >= 0xC0, 2, 1)))
        second = w.start + wide
        capital = differs[w.start] & (second < w.end) & ~differs[second]
        # a word begins a sentence if it is a row's first or one of these stands before it
        ends = np.zeros(256, bool)
        ends[list(b".!?:;\n\"'([")] = True
        seen = np.concatenate([[0], np.cumsum(ends[data])])
        begins = np.ones(n, bool)
        begins[1:] = (seen[w.start[1:]] > seen[w.end[:-1]]) | (w.row[1:] != w.row[:-1])
        digit = (pad[w.start] >= 48) & (pad[w.start] <= 57)
        kind = np.zeros(n, np.int8)
        kind[capital & ~begins] = NAME
        kind[digit | _among(w.hash, numbers)] = NUMBER
        after = np.zeros(n, bool)
        after[1:] = (kind[:-1] == NUMBER) & (w.row[1:] == w.row[:-1]) & (w.start[1:] - w.end[:-1] <= 2)
        kind[after & (kind == LITERAL) & _among(w.hash, units)] = UNIT
        goes_on = np.zeros(n, bool)
        goes_on[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | (kind[1:] == NUMBER)) & ~begins[1:]
        goes_on[1:] |= (kind[1:] == NUMBER) & (kind[:-1] == NUMBER) & (w.row[1:] == w.row[:-1]) & (w.start[1:] - w.end[:-1] == 1)
        start = np.flatnonzero(~goes_on)
        rank = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        self.value = np.add.reduceat(mix(w.hash + rank.astype(U)), start) if n else np.zeros(0, U)
        self.kind, self.capital = kind[start], capital[start] & (kind[start] == LITERAL)
        self.words = np.diff(w.first)
        self.hash = np.where(self.kind == LITERAL, w.hash[start], _SLOT[self.kind])
        self.row = w.row[start]
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))
        self.literals = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])

    def inside(self) -> Templates:
        """The same templates with a capitalised first word as a name, as it is where the text stands within a sentence."""
        t = copy.copy(self)
        first = self.first[:-1][np.diff(self.first) > 0]
        first = first[self.capital[first]]
        t.kind, t.hash = self.kind.copy(), self.hash.copy()
        t.kind[first], t.hash[first] = NAME, _SLOT[NAME]
        t.literals = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
        return t

    def windows(self, size: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of one row begin, and their hashes; of those with fewer than half literals, with the slots' values."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        begin = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        dense = (2 * (self.literals[begin + size] - self.literals[begin]) < size) | exact
        out = np.where(dense, U(size) ^ _DENSE, U(size))
        some = np.flatnonzero(dense)
        for k in range(size):
            token = self.hash[begin + k]
            token[some] ^= np.where(self.kind[begin[some] + k] == LITERAL, U(0), self.value[begin[some] + k])
            out = (out ^ token) * U(0xD6E8FEB86659FD93)
            out ^= out >> U(32)
        return begin, mix(out)

    def slots(self, begin: int, size: int) -> list[int]:
        """The values of a window's slots."""
        part = slice(begin, begin + size)
        return self.value[part][self.kind[part] != LITERAL].view(np.int64).tolist()


class Bloom:
    """A Bloom filter with two probes and 16 bits or more for each of `count` hashes."""

    def __init__(self, count: int) -> None:
        self.bits = max(10, (16 * max(1, count)).bit_length())
        self.field = np.zeros(1 << (self.bits - 3), np.uint8)

    def _probes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(((hashes >> U(s)) & U((1 << self.bits) - 1)).astype(np.int64) for s in (0, 64 - self.bits))

    def add(self, hashes: np.ndarray) -> None:
        for p in self._probes(hashes):
            np.bitwise_or.at(self.field, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self._probes(hashes)
        out = (self.field[a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 1
        some = np.flatnonzero(out)
        out[some] = (self.field[b[some] >> 3] >> (b[some] & 7).astype(np.uint8)) & 1 == 1
        return out


def _items(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The windows of the items: item_id, place, size, tokens, hash, slots, dense (hashed with its slots' values)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, units = _set(NUMBERS), _set(UNITS)
        for batch in batches:
            for b in slices(batch):
                whole, out = Templates(b.column(1), numbers, units), []
                count = np.diff(whole.first)
                long = (count >= LEAST) | (whole.words >= EXACT)
                for t in (whole, whole.inside()):
                    for size in sorted({window, *count[long & (count < window)].tolist()}):
                        begin, h = t.windows(size, size < LEAST)
                        for p, x in zip(begin.tolist(), h.view(np.int64).tolist()):
                            r = int(t.row[p])
                            own = size == window or count[r] == size and long[r]
                            if own and (t is whole or p == t.first[r] and t.kind[p] != whole.kind[p]):
                                out.append((r, p - int(t.first[r]), size, int(count[r]), x, t.slots(p, size), bool(size < LEAST or 2 * (t.literals[p + size] - t.literals[p]) < size)))
                r, *rest = zip(*out) if out else ((),) * 7
                types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r, pa.int64())), *(pa.array(v, k) for v, k in zip(rest, types))], names=["item_id", "place", "size", "tokens", "hash", "slots", "dense"])

    narrow = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(kernel), "item_id long, place int, size int, tokens int, hash long, slots array<long>, dense boolean")


def _bloom(items: DataFrame) -> tuple[Bloom, list[int]]:
    """The filter of the items' windows, built by partition and united here; and the sizes of windows."""
    about = items.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    count = about.n

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(count)
        for b in batches:
            own.add(b.column(0).to_numpy(zero_copy_only=False).view(U))
        yield pa.RecordBatch.from_arrays([pa.array([own.field.tobytes()], pa.binary())], names=["field"])

    out = Bloom(count)
    for row in items.select("hash").coalesce(4).mapInArrow(lean(kernel), "field binary").toLocalIterator():
        out.field |= np.frombuffer(row.field, np.uint8)
    return out, sorted(about.sizes)


def _joined(alignments: list[dict], size: int, tokens: int, cover: float) -> tuple[float, int] | None:
    """The share of an item that its alignments in a document cover together and how many slots have other values, at best; None where that isn't enough."""
    near: list[list[dict]] = []
    for a in sorted(alignments, key=lambda a: a["shift"]):
        if near and a["shift"] - near[-1][-1]["shift"] <= NEAR:
            near[-1].append(a)
        else:
            near.append([a])
    best = None
    for some in near:
        there, back, covered = {}, {}, set()
        for a in sorted(some, key=lambda a: (-a["n"], a["shift"])):
            more = {t for p in a["places"] for t in range(p, p + size)} - covered
            x, y = dict(there), dict(back)
            if more and all(x.setdefault(p["slots"], p["doc_slots"]) == p["doc_slots"] and y.setdefault(p["doc_slots"], p["slots"]) == p["slots"] for p in a["pairs"]):
                there, back = x, y
                covered |= more
        n = len(covered)
        if n and (n >= cover * tokens or n >= ENOUGH):
            found = (n / tokens, -sum(p != q for p, q in there.items()))
            best = found if best is None else max(best, found)
    return best and (best[0], -best[1])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """key_id, key_text, item_id, covered (share of the item's tokens) and reparameterised (slots of other values) by document and item."""
    items = cut(_items(benchmark, item_col, item_text_col, window), "benchmark-windows")
    bloom, sizes = _bloom(items)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, units = _set(NUMBERS), _set(UNITS)
        for batch in batches:
            for b in slices(batch):
                t, out = Templates(b.column(2), numbers, units), []
                for size in sizes:
                    begin, h = t.windows(size, size < LEAST)
                    some = np.flatnonzero(bloom.has(h))
                    for p, x in zip(begin[some].tolist(), h[some].view(np.int64).tolist()):
                        r = int(t.row[p])
                        out.append((r, p - int(t.first[r]), x, t.slots(p, size)))
                r, *rest = zip(*out) if out else ((),) * 4
                r, types = pa.array(r, pa.int64()), (pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), *(pa.array(v, k) for v, k in zip(rest, types))], names=["key_id", "key_text", "at", "hash", "doc_slots"])

    hits = rows.keyed(docs, id_col, text_col).mapInArrow(lean(kernel), "key_id long, key_text long, at long, hash long, doc_slots array<long>")
    joined = hits.join(items, "hash").withColumn("shift", F.col("at") - F.col("place"))
    # dense windows are alignments of their own, as what they add mustn't make others disagree
    one = joined.groupBy("key_id", "key_text", "item_id", "shift", "dense").agg(
        F.sort_array(F.collect_set("place")).alias("places"), F.max("size").alias("size"), F.max("tokens").alias("tokens"), F.flatten(F.collect_list(F.arrays_zip("slots", "doc_slots"))).alias("pairs")
    )
    one = one.withColumn("pairs", F.array_distinct("pairs"))
    # tokens under the union of the windows: each adds what the one before it doesn't reach
    step = F.expr("aggregate(places, named_struct('n', 0, 'to', 0), (s, p) -> named_struct('n', s.n + p + size - greatest(p, s.to), 'to', p + size), s -> s.n)")
    one = one.withColumn("n", step)
    alike = one.groupBy("key_id", "key_text", "item_id").agg(F.max("size").alias("size"), F.max("tokens").alias("tokens"), F.collect_list(F.struct("shift", "n", "places", "pairs")).alias("alignments"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [_joined(b.column(5)[i].as_py(), b.column(3)[i].as_py(), b.column(4)[i].as_py(), cover) for i in range(b.num_rows)]
            r = pa.array([i for i, x in enumerate(best) if x], pa.int64())
            covered, other = zip(*(x for x in best if x)) if len(r) else ((), ())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(r) for k in range(3)), pa.array(covered, pa.float64()), pa.array(other, pa.int64())], names=["key_id", "key_text", "item_id", "covered", "reparameterised"])

    return alike.mapInArrow(lean(join), "key_id long, key_text long, item_id long, covered double, reparameterised long")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, covered, reparameterised of each contaminated document and item."""
    return find(docs, benchmark, **options).select(rows.id_of(F.col("key_id")).alias("doc_id"), "item_id", "covered", "reparameterised")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that no item contaminates, as they are."""
    keys = cut(find(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("key_id", "key_text").distinct(), "contaminated")
    return rows.without(docs, keys, keys.count(), id_col, text_col)
