"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nystroem landmarks.

The kernel compares two words by the subsequences of four letters, in order
and within SPAN letters, that they share; one that spans s letters weighs
DECAY ** s. So an insult with characters put in or left out still shares many
of them. Words are compared in lower case, without accents, after letters that stand apart are joined: single letters that follow each other ("i d i o t"), parts of one or
two letters that only punctuation separates ("i.d.i.o.t"), and parts between which one of JOINERS stands alone ("id-iot"). Letters and digits of all scripts
are letters of their own; a subsequence is known by a hash of its four letters.

Training takes a bounded sample of labelled documents (at most `labelled` of
each label, those whose ids have the smallest hash). Its sentences carry their document's label; as
most sentences of a toxic document hold no insult, the machine learns from
bags: the words of clean sentences are negative, and of toxic sentences those
that witness the label (at first by their counts of sentences, then by the machine itself) are
positive, and so are virtual examples of the foremost with a letter put in, doubled, left out or replaced. Features are the kernel values to landmark words, whitened by the
landmarks' own kernel matrix; the squared-hinge machine is solved by Newton's
method on the clean words most like the landmarks, to which those that the solution
decides wrongly are added, until none is left of all words. As the decision is linear in the kernel, landmarks and weights fold
into one weight per subsequence: scoring a word takes ten lookups a letter,
however many landmarks there are.

A document is judged by windows of WINDOW words. A window's evidence is the sum, over its sentences' distinct words that are decided
positive, of the log-odds with which decisions of that height occur in toxic
and in clean documents that the machine did not see, where that is above 1; a share DISGUISED of insults is taken to be as high as the virtual examples are. It is toxic where clean windows
of so many words gather as much by chance with a probability of at most `false_alarms` over the document's number of windows: by the rates of
such decisions a clean word, a compound negative binomial sum whose spread is that between clean windows.
So clean text beside an insult changes little, and length alone is no evidence.

Defined results: null and empty texts, and texts without letters, are never
toxic; texts and words of any length are learned and scored whole; repeated rows are judged each; a
label that is null is ignored, of several labels for an id the largest counts;
where either label is missing there is no model and nothing is toxic; words of equal rank
as landmarks go by the alphabet. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftwork.llm.batches import U, lean, mix, raw, slices

SPAN, DECAY = 6, 0.7
LABELLED = 2000
LANDMARKS = 512
#: Clean words that the machine begins with, those most like the landmarks, and that are added at most to each solution; all are looked at.
HARD = 10_000
FALSE_ALARMS = 0.001
#: Costs of errors: of all, of positives together against negatives together, of a virtual example.
COST, BALANCE, VIRTUAL = 10.0, 0.2, 2.0
#: Edges of the bins of decisions, and the least evidence for a toxic text.
EDGES, LEAST_EVIDENCE = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.25, 1.5, 2.0, 3.0]), 2.0
#: Words of a window.
WINDOW = 256
#: The grid on which sums of evidence are told apart, and its length.
GRID, LONGEST_SUM = 0.25, 1024
#: Subsequences of positions (i, i + a, i + b, i + c).
GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]
#: Subsequences are hashed to so many codes.
CODES = 1 << 21
START = 0
JOINERS = "-_*'~+\u2019\u00b7\u00ad"
#: Of toxic documents' insults, those taken to be written like the virtual examples.
DISGUISED = 0.1


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By character of the basic plane: 1 for a letter or digit, 2 for one of JOINERS, 64 for space, 65 for the end of a sentence, else 0; and its letter without accents."""
    kind, bare = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for i in range(0xFFFF):
        c = " " if 0xD800 <= i < 0xE000 else chr(i)
        if c.isalnum():
            kind[i], bare[i] = 1, ord(unicodedata.normalize("NFD", c)[0])
        elif c in "\n.!?\u3002\uff01\uff1f":
            kind[i] = 65
        elif c.isspace():
            kind[i] = 64
        elif c in JOINERS:
            kind[i] = 2
    kind[0xFFFF] = 1  # stands for the other planes
    return kind, bare


class Letters:
    """The joined words of some texts: letters after START, word of each, and row and sentence of each word."""

    def __init__(self, texts: pa.Array) -> None:
        table, bare = _characters()
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        data, _ = raw(low)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        count = pc.utf8_length(low).to_numpy().astype(np.int64)
        begin = np.cumsum(count) - count
        kind = table[np.minimum(points, 0xFFFF)]
        letter = kind == 1
        n = len(kind)
        before = np.zeros(n, bool)
        before[1:] = letter[:-1]
        real = begin[(count > 0)]
        before[real] = False
        start = np.flatnonzero(letter & ~before)
        after = np.zeros(n, bool)
        after[:-1] = letter[1:]
        after[real[1:] - 1] = False
        end = np.flatnonzero(letter & ~after) + 1
        row = np.searchsorted(real, start, "right") - 1
        spaces = np.concatenate([[0], np.cumsum(kind == 64)])
        stops = np.concatenate([[0], np.cumsum(kind == 65)])
        size, gap = end - start, start[1:] - end[:-1]
        same = (row[1:] == row[:-1]) & (stops[start[1:]] == stops[end[:-1]])
        blank = spaces[start[1:]] > spaces[end[:-1]]
        both, least = np.maximum(size[1:], size[:-1]), np.minimum(size[1:], size[:-1])
        # points within a word are no ends of sentences: "i.d.i.o.t"
        dotted = (row[1:] == row[:-1]) & ~blank & (gap <= 2) & (least <= 2)
        tied = (row[1:] == row[:-1]) & (gap == 1) & (kind[end[:-1]] == 2)
        join = (same & blank & (gap <= 3) & (both == 1)) | dotted | tied
        fresh = np.concatenate([[True], ~join]) if len(start) else np.zeros(0, bool)
        word = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        self.row = np.flatnonzero(count > 0)[row[first]]
        self.sentence = stops[start[first]] + self.row
        place = (np.cumsum(size) - size)[first]  # of each word's first letter among all letters
        of = np.repeat(word, size)
        # each word begins with a symbol of its own, so that a beginning differs from a middle
        self.symbol = np.full(len(of) + len(first), START, np.uint32)
        at = np.arange(len(of)) + of + 1
        own = points[letter]
        self.symbol[at] = np.where(own < 0xFFFF, bare[np.minimum(own, 0xFFFF)], own)
        self.word = np.repeat(np.arange(len(first)), np.diff(np.concatenate([place, [len(of)]])) + 1)
        self.first = place + np.arange(len(first))
        self.points, self.place = points[letter], place

    def strings(self) -> list[str]:
        text = self.points.astype(np.uint32).tobytes().decode("utf-32-le")
        ends = [*self.place[1:].tolist(), len(text)]
        return [text[a:b] for a, b in zip(self.place.tolist(), ends)]

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Codes of the subsequences by their first letter, which of them lie in one word, and their span."""
        w = np.concatenate([self.word, np.full(SPAN, -1)])
        n = len(self.symbol)
        one, two = (mix(self.symbol.astype(U) * U(2) + U(k)) for k in (0, 1))
        h = [np.concatenate([(x >> U(s)).astype(np.int32) & np.int32(CODES - 1), np.zeros(SPAN, np.int32)]) for x, s in ((one, 0), (one, 32), (two, 0), (two, 32))]
        for c in range(3, SPAN):
            inside = self.word == w[c : n + c]
            ends = h[0][:n] ^ h[3][c : n + c]
            for b in range(2, c):
                three = ends ^ h[2][b : n + b]
                for a in range(1, b):
                    yield three ^ h[1][a : n + a], inside, c + 1

    def norms(self) -> np.ndarray:
        """By word: the root of its subsequences' squared weights."""
        size = np.diff(np.concatenate([self.first, [len(self.symbol)]]))
        total = np.zeros(len(size))
        for *_, c in GAPS:
            total += np.maximum(size - c, 0) * DECAY ** (2 * (c + 1))
        return np.sqrt(total)

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """By word: the weights of its subsequences, each times DECAY ** span, over the word's norm; shorter words have 0."""
        if not len(self.first):
            return np.zeros(0)
        total = np.zeros(len(self.symbol), np.float32)
        for code, inside, span in self.subsequences():
            total += weights[code] * inside * np.float32(DECAY**span)
        norm = self.norms()
        return np.add.reduceat(total, self.first).astype(np.float64) / np.where(norm > 0, norm, 1.0)

    def kernel(self, marks: list[dict[int, float]]) -> np.ndarray:
        """By word: its kernel value to each landmark, which is given as its subsequences' normalised weights."""
        place = {c: i + 1 for i, c in enumerate(sorted({c for m in marks for c in m}))}
        rows = np.zeros((len(place) + 1, len(marks)), np.float32)
        for j, m in enumerate(marks):
            for c, v in m.items():
                rows[place[c], j] = v
        short = np.zeros(CODES, np.int32)
        short[list(place)] = list(place.values())
        out = np.zeros((len(self.first), len(marks)), np.float32)
        for code, inside, span in self.subsequences():
            at = short[code] * inside
            some = np.flatnonzero(at)
            for part in np.array_split(some, max(1, len(some) // 100_000)):
                if len(part):
                    word, begin = np.unique(self.word[part], return_index=True)
                    out[word] += np.add.reduceat(rows[at[part]], begin, axis=0) * np.float32(DECAY**span)
        norm = self.norms()
        return out / np.where(norm > 0, norm, 1.0)[:, None].astype(np.float32)


def solve(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """A squared-hinge support vector machine by Newton's method; the intercept is not regularised."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(x.shape[1]), np.diag([*np.ones(x.shape[1] - 1), 1e-8])

    def loss(v: np.ndarray) -> float:
        return float(0.5 * v @ ridge @ v + 0.5 * (cost * np.maximum(0, 1 - y * (x @ v)) ** 2).sum())

    for _ in range(30):
        inside = np.flatnonzero(y * (x @ w) < 1)
        part, c = x[inside], cost[inside][:, None]
        to = np.linalg.solve(part.T @ (part * c) + ridge + 1e-9 * np.eye(len(w)), (part * c).T @ y[inside])
        step, was = 1.0, loss(w)
        while step > 1e-3 and loss(w + step * (to - w)) > was:
            step /= 2
        if step <= 1e-3 or np.abs(step * (to - w)).max() < 1e-6:
            break
        w = w + step * (to - w)
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, false_alarms: float = FALSE_ALARMS) -> None:
        fit, held = [i for i in range(len(texts)) if i % 3], [i for i in range(len(texts)) if i % 3 == 0]
        self._machine([texts[i] for i in fit], [toxic[i] for i in fit], landmarks)
        self._threshold([texts[i] for i in held], np.array([toxic[i] for i in held]), false_alarms)

    def __getstate__(self) -> dict:
        some = np.flatnonzero(self.weights).astype(np.int32)
        return self.__dict__ | {"weights": (some, self.weights[some])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        some, values = self.weights
        self.weights = np.zeros(CODES, np.float32)
        self.weights[some] = values

    def _counts(self, texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Distinct words in order, in how many toxic and how many clean sentences each is, and how many such sentences there are."""
        counts: dict[str, list[int]] = {}
        n_pos = n_neg = 0
        for at, letters in self._parts(texts):
            inverse, own = pd.factorize(np.array(letters.strings(), object))
            pairs = np.unique(np.stack([letters.sentence, inverse], 1), axis=0)
            sentences, first = np.unique(letters.sentence, return_index=True)
            of = toxic[at + letters.row[first]] == 1
            n_pos, n_neg = n_pos + int(of.sum()), n_neg + int((~of).sum())
            bad = of[np.searchsorted(sentences, pairs[:, 0])]
            for w, p, n in zip(own.tolist(), np.bincount(pairs[bad, 1], minlength=len(own)).tolist(), np.bincount(pairs[~bad, 1], minlength=len(own)).tolist()):
                c = counts.setdefault(w, [0, 0])
                c[0] += p
                c[1] += n
        seen = np.array(sorted(counts), object)
        pos, neg = (np.array([counts[w][i] for w in seen], np.int64) for i in (0, 1))
        return seen, pos, neg, max(1, n_pos), max(1, n_neg)

    def _machine(self, texts: list[str], toxic: list[int], most: int) -> None:
        seen, pos, neg, n_pos, n_neg = self._counts(texts, np.array(toxic))
        odds = ((pos + 0.1) / n_pos) / ((neg + 0.5) / n_neg)
        long = np.array([len(w) >= 4 for w in seen], bool)
        witness = long & (pos >= 2) & (odds >= 8) & (pos * np.log(odds) > 8)
        rank = np.argsort(-(pos * np.log(np.maximum(odds, 1e-9))) * witness, kind="stable")
        marks = rank[: min(most // 3, int(witness.sum()))]
        if not len(marks):
            self.weights, self.bias, self.landmarks, self.disguised = np.zeros(CODES, np.float32), -1.0, [], np.zeros(len(EDGES) + 1)
            return
        first = [self._mark(seen[j]) for j in marks]
        like = np.concatenate([letters.kernel(first).max(1) for _, letters in self._words(seen)])
        # landmarks are the foremost witnesses and the clean words most like them
        hard = np.argsort(-(like * ~witness), kind="stable")
        hard = hard[neg[hard] > 0][:HARD]
        inserted = self._inserted(seen[marks].tolist())
        marks = np.concatenate([marks, hard[: most - len(marks)]])
        columns = [self._mark(seen[j]) for j in marks]

        def values(words: np.ndarray) -> np.ndarray:
            return np.concatenate([np.zeros((0, len(columns)))] + [letters.kernel(columns).astype(np.float64) for _, letters in self._words(words)])

        gram = values(seen[marks])
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        whiten = vector / np.sqrt(np.maximum(value, 1e-3))
        used = np.union1d(np.flatnonzero(witness), hard)
        x, extra = values(seen[used]) @ whiten, values(np.array(inserted, object)) @ whiten
        positive = witness.copy()
        for turn in range(6):
            good, own = positive[used], (positive | (neg > 0))[used]
            y = np.concatenate([np.where(good[own], 1.0, -1.0), np.ones(len(extra))])
            cost = np.concatenate([np.where(good, np.log1p(pos[used]), np.log1p(neg[used]))[own], np.full(len(extra), VIRTUAL)])
            cost *= COST
            cost[y > 0] *= max(1.0, BALANCE * cost[y < 0].sum() / cost[y > 0].sum())
            w, self.bias = solve(np.concatenate([x[own], extra]), y, cost)
            alpha = whiten @ w
            self.weights = np.zeros(CODES, np.float32)
            for a, column in zip(alpha, columns):
                self.weights[list(column)] += a * np.array(list(column.values()), np.float32)
            decided = np.concatenate([letters.fold(self.weights) for _, letters in self._words(seen)]) + self.bias
            positive = witness | ((decided > 0) & (pos > 0) & (neg == 0) & (odds >= 8))
            out = np.ones(len(seen), bool)
            out[used] = False
            wrong = np.flatnonzero(out & np.where(positive, decided < 0.9, (neg > 0) & (decided > -0.9)))
            if not len(wrong):
                break
            more = wrong[np.argsort(-np.abs(decided[wrong]), kind="stable")[:HARD]]
            x, used = np.concatenate([x, values(seen[more]) @ whiten]), np.concatenate([used, more])
        self.landmarks, f = seen[marks].tolist(), extra @ w + self.bias
        self.disguised = np.bincount(np.digitize(f[f > 0], EDGES), minlength=len(EDGES) + 1) / max(1, len(f))

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, Letters]]:
        """The texts in slices of bounded size: the first one's number, and their words."""
        at = 0
        for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"]), most=1_000_000):
            yield at, Letters(part.column(0))
            at += part.num_rows

    def _words(self, words: np.ndarray) -> Iterator[tuple[int, Letters]]:
        """The same of texts that are a word each."""
        at = 0
        for part in slices(pa.RecordBatch.from_arrays([pa.array(words.tolist(), pa.large_string())], names=["text"]), most=100_000):
            yield at, Letters(part.column(0))
            at += part.num_rows

    def _inserted(self, words: list[str]) -> list[str]:
        """Virtual examples: each word with one letter doubled, put in, replaced or (of longer words) left out, at every place within."""
        out = []
        for w in words:
            for i in range(1, len(w)):
                other = words[(i * 7 + len(w)) % len(words)][0]
                out += [w[:i] + w[i] + w[i:], w[:i] + "x" + w[i:], w[:i] + other + w[i:]]
                if len(w) >= 6:
                    out += [w[:i] + w[i + 1 :], w[:i] + other + w[i + 1 :]]
        return out

    def _mark(self, word: str) -> dict[int, float]:
        """A landmark's normalised weight of each subsequence."""
        one, out = Letters(pa.array([word], pa.large_string())), {}
        for code, inside, span in one.subsequences():
            for c in code[inside].tolist():
                out[c] = out.get(c, 0.0) + DECAY**span
        norm = float(one.norms()[0]) or 1.0
        return {c: v / norm for c, v in out.items()}

    def words(self, texts: pa.Array) -> tuple[Letters, np.ndarray]:
        letters = Letters(texts)
        return letters, letters.fold(self.weights) + self.bias

    @staticmethod
    def _windows(letters: Letters, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The window of each word, the row of each window, and how many each row has."""
        words = np.bincount(letters.row, minlength=texts)
        count = -(-words // WINDOW)
        place = np.arange(len(letters.row)) - (np.cumsum(words) - words)[letters.row]
        return (np.cumsum(count) - count)[letters.row] + place // WINDOW, np.repeat(np.arange(texts), count), count

    @staticmethod
    def _distinct(letters: Letters, f: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and decision of each distinct word of a sentence that is decided positive; words of equal decisions and lengths count as one."""
        hit = np.flatnonzero(f > 0)
        size = np.diff(np.concatenate([letters.first, [len(letters.symbol)]]))
        one = np.unique(np.stack([window[hit], letters.sentence[hit], size[hit], f[hit].view(np.int64)], 1), axis=0)
        return one[:, 0], np.ascontiguousarray(one[:, 3]).view(np.float64)

    def _threshold(self, texts: list[str], toxic: np.ndarray, false_alarms: float) -> None:
        """Evidence of a decision: log-odds of its height among words of toxic against clean texts, made monotone; and what chance gathers."""
        at, of, words, bad = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for begin, letters in self._parts(texts):
            n = int(letters.row.max(initial=-1)) + 1
            window, row, _ = self._windows(letters, n)
            w, f = self._distinct(letters, letters.fold(self.weights) + self.bias, window)
            at.append(w + sum(map(len, words)))
            of.append(np.digitize(f, EDGES))
            words.append(np.bincount(window, minlength=len(row)))
            bad.append(toxic[begin : begin + n][row] == 1)
        at, of, words, bad = map(np.concatenate, (at, of, words, bad))
        bins, total = len(EDGES) + 1, max(1, words[~bad].sum())
        pos, neg = np.bincount(of[bad[at]], minlength=bins) + 0.5, np.bincount(of[~bad[at]], minlength=bins).astype(float)
        pos += DISGUISED * pos.sum() * self.disguised
        odds = np.log(pos / max(1, words[bad].sum())) - np.log((neg + 0.5) / total)
        self.evidence = np.maximum.accumulate(np.where(odds > 1, np.round(odds / GRID) * GRID, 0))
        self.rate = np.where(self.evidence > 0, (neg + 0.5) / total, 0.0)
        # how much more the windows' counts differ than those of a Poisson process
        n, want = np.bincount(at[self.evidence[of] > 0], minlength=len(words))[~bad], words[~bad] * self.rate.sum()
        square = float((want**2).sum())
        self.spread = min(20.0, max(1e-3, float(((n - want) ** 2 - want).sum()) / square)) if square > 0 else 1e-3
        # the least sum that clean windows reach so seldom, by half powers of two of words and by powers of two of windows
        step = np.maximum(1, np.round(self.evidence / GRID)).astype(int)
        z = np.exp(-2j * np.pi * np.arange(LONGEST_SUM) / LONGEST_SUM)
        mean = sum(r * (1 - z**k) for r, k in zip(self.rate, step) if r > 0)
        self.limits = np.full((2 * WINDOW.bit_length(), 40), np.inf)
        if bad.any() and not bad.all():
            for half in range(len(self.limits)):
                shape = np.exp(-np.log1p(self.spread * 2 ** (half / 2) * mean) / self.spread)
                tail = 1 - np.cumsum(np.fft.ifft(shape).real)  # tail[k]: probability of more than k steps
                for k in range(40):
                    low = tail <= max(false_alarms / 2**k, 1e-12)
                    self.limits[half, k] = max(LEAST_EVIDENCE, (int(np.argmax(low)) if low.any() else LONGEST_SUM) * GRID)

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: the evidence of its foremost window as a share of that and the limit, so 0.5 at the limit; whether toxic; and sentences with an insult."""
        letters, all_f = self.words(texts)
        window, row, count = self._windows(letters, len(texts))
        at, f = self._distinct(letters, all_f, window)
        total = np.bincount(at, self.evidence[np.digitize(f, EDGES)], len(row))
        half = np.ceil(2 * np.log2(np.bincount(window, minlength=len(row)))).astype(int)
        limit = np.minimum(self.limits[half, np.minimum(np.ceil(np.log2(count[row])).astype(int), 39)], 1e300)
        best, bad = np.zeros(len(texts)), np.zeros(len(texts), bool)
        np.maximum.at(best, row, total / (total + limit))
        bad[row[total > limit]] = True
        hit = np.flatnonzero(all_f > 0)
        hit = hit[self.evidence[np.digitize(all_f[hit], EDGES)] > 0]
        some = np.unique(np.stack([letters.sentence[hit], letters.row[hit]], 1), axis=0)[:, 1]
        return best, bad, np.bincount(some, minlength=len(texts))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Model | None:
    """Fits the model in one task, on a sample that is chosen among the labels, so that no other text is moved."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    # only hashes that can be among the smallest are ranked, so that no task sorts all labels of a class
    low = {r.y: min((1 << 63) - 1, -(1 << 63) + int((labelled + 10 * labelled**0.5 + 100) / r.n * 2.0**64)) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = F.col("h") <= F.when(F.col("y") == 1, low.get(1, 0)).otherwise(low.get(0, 0)).cast("long")
    known = known.where(some).withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))).select("doc_id", "y", "r")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    some = own.join(F.broadcast(known.where(F.col("r") <= labelled)), "doc_id").select("y", "r", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(r["y"], r["r"]): r["text"] for b in batches for r in sorted(b.to_pylist(), key=lambda r: r["text"])}.items())
        if len({y for (y, _), _ in rows}) == 2:
            model = Model([t for _, t in rows], [y for (y, _), _ in rows])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.__getstate__())], pa.binary())], names=["model"])

    found = some.repartition(1).mapInArrow(lean(fit), "model binary").collect()
    if not found:
        return None
    model = Model.__new__(Model)
    model.__setstate__(pickle.loads(found[0].model))
    return model


def detect(docs: DataFrame, labels: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", all_rows: bool = False) -> DataFrame:
    """doc_id, toxicity (from 0 to 1, above 0.5 if toxic) and toxic_sentences of the toxic rows; of all rows, with a column toxic, on request."""
    model = model or train(docs, labels, id_col, text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=1_000_000):
                if model is None:
                    p, bad, sentences = np.zeros(b.num_rows), np.zeros(b.num_rows, bool), np.zeros(b.num_rows, np.int64)
                else:
                    p, bad, sentences = model.judge(b.column(1))
                out = pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(sentences, pa.int64()), pa.array(bad)], names=["doc_id", "toxicity", "toxic_sentences", "toxic"])
                yield out if all_rows else out.filter(out.column(3)).select(["doc_id", "toxicity", "toxic_sentences"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(lean(kernel), "doc_id long, toxicity double, toxic_sentences long" + ", toxic boolean" * all_rows)
