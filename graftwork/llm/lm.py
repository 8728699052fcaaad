"""A gated recurrent language model in numpy, trained on the corpus and scoring every document whole.

Tokens are words (runs of letters and digits, in lower case); the end of a text is one
more. The vocabulary is the VOCABULARY most frequent words of all documents; any other word
is "unknown" and costs, besides, its spelling under a byte-bigram model. What stands between words, before the first and after
the last (punctuation, symbols, white space) costs its bytes under a second byte-bigram model, and a word's capitals the
share of their kind (none, the first letter, all, or any others, which cost a bit a letter more). All these are counted
over all documents too. So every byte of a text has its part in a proper log-likelihood.

The output softmax is factored by classes: p(word) = p(class) p(word | class);
end and unknown are classes of their own, the other words fall by frequency into
classes of about equal sums of root frequencies, so a token costs two short softmaxes.

Training goes over all documents once, in ROUNDS rounds that take each its share of
them by hash. In a round every task trains a replica on its documents, in parallel streams
with truncated backpropagation (the state goes on from window to window, gradients don't; a stream takes a
whole text after the other, from the first token to the last, with an empty state for each), and the replicas are averaged by their tokens, in
two levels. What is gathered - word counts, spellings, replicas - so grows with the corpus.

Scoring runs the documents of a batch in step, longest first and TEXTS together, each with its
state from the first token to the last, and takes the softmaxes of many steps at once.

Defined results: null text counts as empty; an empty text is its end alone;
texts of any length are learned and scored whole; repeated rows are scored each; of words as frequent
as the vocabulary's last the least hashes are in it; an empty
table has no rows. Other columns are ignored. Results depend slightly on how
the rows lie in files, as a replica sees those of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.batches import U, Words, _tables, in_words, lean, raw, slices
from graftwork.storage import cut, drop

VOCABULARY, HIDDEN, CLASSES = 2000, 24, 32
STREAMS, WINDOW, RATE, ROUNDS = 512, 16, 0.01, 2
#: Tokens whose softmaxes are taken at once.
AT_ONCE = 8192
#: Texts that are scored in step.
TEXTS = 1024
#: Bytes of text that are scored at once.
SCORED_BYTES = 32_000_000
#: Logits that exp() takes as they are.
BOUNDED = 60.0
#: Rows that go into one replica's part of an average; parts of parameters are rows.
FAN = 64
END, UNKNOWN = 0, 1


#: Kinds of a word's capitals.
SMALL, FIRST, ALL, OTHER = range(4)


class Lexicon:
    """Ids of words by hash, their classes, and the log-probabilities of spellings, of what stands between words and of capitals."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, texts: int, words: int, bigrams: np.ndarray, gaps: np.ndarray, cases: np.ndarray) -> None:
        size = len(hashes) + 2
        root = np.sqrt(counts.astype(float))
        bins = np.minimum((np.cumsum(root) - root / 2) / max(root.sum(), 1e-9) * (CLASSES - 2), CLASSES - 3).astype(int)
        _, bins = np.unique(bins, return_inverse=True)  # no empty classes
        self.of = np.concatenate([[0, 1], bins + 2]).astype(np.int16)  # sorted by digits
        self.start = np.searchsorted(self.of, np.arange(self.of[-1] + 2))
        share = np.concatenate([[texts], [max(words - counts.sum(), 1)], counts]).astype(float) + 1
        self.unigram = np.log(share / share.sum()).astype(np.float32)
        self.spelling, self.gaps = (np.log((x + 0.01) / (x + 0.01).sum(1, keepdims=True)).astype(np.float32) for x in (bigrams.astype(float), gaps.astype(float)))
        self.cases = np.log((cases + 1) / (cases + 1).sum())
        self.size = size
        # tables of ids by 16 bits of the hash each, those that meet in one going to the next, and at last a search
        self.by_id, self.slots, left = np.concatenate([np.zeros(2, U), hashes.astype(U)]), [], np.arange(2, size)
        for shift in (0, 16):
            slot, slots = self._slot(self.by_id[left], shift), np.full(1 << 16, UNKNOWN, np.int32)
            slots[slot] = left
            self.slots.append((shift, slots))
            left = left[slots[slot] != left]
        self.left = left[np.argsort(self.by_id[left])]

    @staticmethod
    def _slot(hashes: np.ndarray, shift: int) -> np.ndarray:
        return (hashes >> U(shift) & U(0xFFFF)).astype(np.intp)

    def ids(self, words: Words) -> np.ndarray:
        out = np.full(len(words.hash), UNKNOWN, np.int32)
        tables = [slots.take(self._slot(words.hash, shift)) for shift, slots in self.slots]
        if len(self.left):
            tables.append(self.left[np.minimum(np.searchsorted(self.by_id[self.left], words.hash), len(self.left) - 1)])
        for found in tables:
            np.copyto(out, found, where=self.by_id.take(found) == words.hash, casting="same_kind")
        return out

    def spelled(self, words: Words, ids: np.ndarray) -> np.ndarray:
        """By row: log-probability of the spellings of its unknown words."""
        total = np.zeros(max(len(words.data), 1))
        np.cumsum(self.spelling.reshape(-1).take(adjacent(words.data)), dtype=np.float64, out=total[1:])
        # total[k]: transitions up to byte k; each word begins and ends with byte 0
        some = np.flatnonzero(ids == UNKNOWN)
        start, last = words.start[some], words.end[some] - 1
        own = total[last] - total[start] + self.spelling[0, words.data[start]] + self.spelling[words.data[last], 0]
        return np.bincount(words.row[some], own, len(words.at) - 1)

    def rest(self, words: Words, column: pa.Array) -> np.ndarray:
        """By row: log-probability of what stands between its words, and of its words' capitals."""
        pair, at, first, last = between(words)
        value = np.append(self.gaps.reshape(-1), np.float32(0)).astype(np.float64)  # at -1: nothing
        total = np.concatenate([[0.0], np.cumsum(value[pair])])
        edge = np.searchsorted(at, words.at)
        out = total[edge[1:]] - total[edge[:-1]] + value[first] + value[last]
        kind, size = capitals(words, column)
        return out + np.bincount(words.row, self.cases[kind] - np.where(kind == OTHER, size * np.log(2), 0.0), len(words.at) - 1)


def between(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of bytes of what stands between words, 0 at its ends, as one number each, and the bytes that they go up to; and two more a row: of its first gap where that is empty (else below 0), and of the end of its last."""
    data = words.data
    gap = ~in_words(data)
    shown = data * gap
    full = np.diff(words.at) > 0
    used = gap.copy()
    used[1:] |= gap[:-1]
    begins = words.at[:-1][full]
    used[begins] = gap[begins]
    at = np.flatnonzero(used)
    byte, before = shown[at].astype(np.int64), shown[at - 1].astype(np.int64)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[begins] = True
    before[fresh[at]] = 0
    last, first = np.zeros(len(full), np.int64), np.full(len(full), -1)
    ends = words.at[1:][full] - 1
    last[full] = np.where(gap[ends], data[ends], 0).astype(np.int64) * 256
    first[full] = np.where(gap[begins], -1, 0)
    return before * 256 + byte, at, first, last


def capitals(words: Words, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each word's capitals, and the characters of those that have some."""
    high, low = raw(column)[0], words.data
    inner = (low & 0xC0) == 0x80
    if len(high) == len(low) and np.array_equal((high & 0xC0) == 0x80, inner):  # characters as long in lower case
        at = np.flatnonzero(high != low)
        for _ in range(3):
            at = at - inner[at]
        at = at[np.diff(at, prepend=-1) > 0]
    else:
        high, low = (np.frombuffer(x.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32) for x in (high, low))
        at = np.flatnonzero(~inner)[high != low]
    word = np.searchsorted(words.start, at, "right") - 1
    upper, first = np.bincount(word, minlength=len(words.start)), np.zeros(len(words.start), bool)
    first[word[words.start[word] == at]] = True
    some = np.flatnonzero(upper)
    inner = np.flatnonzero(inner)
    start, end = words.start[some], words.end[some]
    kind, size = np.full(len(upper), SMALL), np.zeros(len(upper), np.int64)
    size[some] = end - start - (np.searchsorted(inner, end) - np.searchsorted(inner, start))
    kind[some] = np.where((upper[some] == 1) & first[some], FIRST, np.where(upper[some] == size[some], ALL, OTHER))
    return kind, size


def adjacent(data: np.ndarray) -> np.ndarray:
    """Each byte but the last with the next one, as one number."""
    out = data[:-1].astype(np.uint16)
    out <<= 8
    out |= data[1:]
    return out


def pair_counts(words: Words) -> np.ndarray:
    """Counts of byte pairs of the same row; then of rows' first bytes, of their last ones, and of empty rows."""
    full = np.diff(words.at) > 0
    first, last = words.data[words.at[:-1][full]], words.data[words.at[1:][full] - 1]
    pairs = np.bincount(adjacent(words.data), minlength=65536)
    pairs -= np.bincount(last[:-1].astype(np.int64) * 256 + first[1:], minlength=65536)
    return np.concatenate([pairs, np.bincount(first, minlength=256), np.bincount(last, minlength=256), [np.sum(~full)]])


def spelling_and_gaps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pair_counts(): counts of pairs within words, and within what stands between them (as between() has them), 0 before and after each."""
    pairs, (first, last) = counts[:65536].reshape(256, 256), counts[65536:-1].reshape(2, 256)
    word, gaps = _tables()[0], np.zeros((256, 256), np.int64)
    spelling = np.where(word[:, None] & word, pairs, 0)
    spelling[0] += np.where(word, pairs[~word].sum(0) + first, 0)
    spelling[:, 0] += np.where(word, pairs[:, ~word].sum(1) + last, 0)
    gaps += np.where(word[:, None] | word, 0, pairs)
    gaps[0] += np.where(word, 0, pairs[word].sum(0) + first)
    gaps[:, 0] += np.where(word, 0, pairs[:, word].sum(1) + last)
    gaps[0, 0] += first[word].sum() + last[word].sum() + counts[-1]
    return spelling.ravel(), gaps.ravel()


def lexicon(docs: DataFrame, most: int = VOCABULARY) -> Lexicon:
    """From all documents: words are counted by task and then together, and so are the bigrams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, cases, texts, held = np.zeros(65536 + 513, np.int64), np.zeros(4, np.int64), 0, []

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            h, c = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            u, inverse = np.unique(h, return_inverse=True)
            return u, np.bincount(inverse, c, len(u)).astype(np.int64)

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            for b in slices(batch):
                w = Words(b.column(0))
                pairs += pair_counts(w)
                cases += np.bincount(capitals(w, b.column(0))[0], minlength=4)
                texts += b.num_rows
                held.append(np.unique(w.hash, return_counts=True))
                if len(held) > 16:
                    held = [merged(held)]
                if len(held) == 1 and len(held[0][0]) > 1_000_000:
                    yield rows(0, held[0][0].view(np.int64), held[0][1])
                    held = []
        if held:
            h, c = merged(held)
            yield rows(0, h.view(np.int64), c)
        spelling, gaps = spelling_and_gaps(pairs)
        some = np.flatnonzero(spelling)
        yield rows(1, some, spelling[some])
        yield rows(2, np.zeros(1, np.int64), np.array([texts]))
        some = np.flatnonzero(gaps)
        yield rows(3, some, gaps[some])
        yield rows(4, np.arange(4), cases)

    text = docs.select(docs["text"])
    counted = cut(text.mapInArrow(lean(count), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "word-counts")
    top = counted.where("kind = 0").orderBy(F.desc("n"), "key").limit(most).collect()
    rest = counted.where("kind IN (1, 3, 4)").collect()  # at most 2 * 65536 + 4
    about = {r.kind: int(r.n or 0) for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    drop(counted)
    tables = {1: np.zeros(65536, np.int64), 3: np.zeros(65536, np.int64), 4: np.zeros(4, np.int64)}
    for r in rest:
        tables[r.kind][r.key] = r.n
    return Lexicon(np.array([r.key for r in top], np.int64).view(U), np.array([r.n for r in top], np.int64), about.get(2, 0), about.get(0, 0), tables[1].reshape(256, 256), tables[3].reshape(256, 256), tables[4])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """Gated recurrent units with a class-factored softmax; parameters are float32 arrays in p."""

    def __init__(self, lexicon: Lexicon, hidden: int = HIDDEN, seed: int = 11) -> None:
        g, v, c = np.random.default_rng(seed), lexicon.size, int(lexicon.of[-1]) + 1
        self.lexicon, self.hidden = lexicon, hidden
        draw = lambda *shape: (g.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        # biases begin at the words' and classes' own shares
        share = np.exp(lexicon.unigram.astype(float))
        by_class = np.bincount(lexicon.of, share, c)
        self.p = {
            "embed": draw(v, hidden), "wx": draw(hidden, 3 * hidden), "bx": np.zeros(3 * hidden, np.float32), "u": draw(hidden, 3 * hidden), "bn": np.zeros(hidden, np.float32),
            "wc": np.zeros((hidden, c), np.float32), "bc": np.log(by_class).astype(np.float32), "wo": np.zeros((v, hidden), np.float32), "bo": lexicon.unigram.copy(),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        """Takes the parameters from an array that flat() gave; where that is of float32, they remain a part of it."""
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].astype(np.float32, copy=False).reshape(x.shape)
            at += x.size

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """x: the input's part of the gates. The next state, and what backpropagation needs."""
        x, h, n, p = x.T, h.T, self.hidden, self.p
        a = p["u"].T @ h
        zr, an = a[: 2 * n], a[2 * n :]
        zr += x[: 2 * n]
        _sigmoid(zr)
        z, r = zr[:n], zr[n:]
        an += p["bn"][:, None]
        c = r * an
        c += x[2 * n :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new.T, z.T, r.T, an.T, c.T

    def gates(self) -> np.ndarray:
        """The input's part of the gates by word."""
        return self.p["embed"] @ self.p["wx"] + self.p["bx"]

    def losses(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probability of each target; with grad, adds the parameters' gradients of -sum and returns that of the states."""
        p, lex = self.p, self.lexicon
        of = lex.of[target]
        order = np.argsort(of, kind="stable")  # a class's targets are a range
        target = target[order]
        edge = np.searchsorted(of[order], np.arange(len(lex.start))).tolist()
        states, d = np.ones((self.hidden + 1, len(order)), h.dtype), None  # the last: biases
        h.T.take(order, 1, out=states[:-1], mode="clip")
        wc, wo = np.vstack([p["wc"], p["bc"]]), np.column_stack([p["wo"], p["bo"]])
        # sums of exponentials of numbers up to BOUNDED are numbers too: only beyond it the greatest is subtracted first
        most = max(float(states.max()), -float(states.min())) if len(order) else 0.0
        bounded = most * max(float(np.abs(wc).sum(0).max()), float(np.abs(wo).sum(1).max())) < BOUNDED
        a = wc.T @ states
        if not bounded:
            a -= a.max(0)
        out = np.concatenate([a[k, edge[k] : edge[k + 1]] for k in range(len(a))])
        np.exp(a, out=a)
        total = a.sum(0)
        out -= np.log(total)
        if grad is not None:
            a /= total
            for k in range(len(a)):
                a[k, edge[k] : edge[k + 1]] -= 1
            g, by_word = states @ a.T, np.zeros_like(wo)
            grad["wc"] += g[:-1]
            grad["bc"] += g[-1]
            d = p["wc"] @ a
        for k in range(2, len(a)):
            i, j, lo, hi = edge[k], edge[k + 1], lex.start[k], lex.start[k + 1]
            if i == j or hi - lo < 2:
                continue
            hk, w = states[:, i:j], wo[lo:hi]
            b = w @ hk
            if not bounded:
                b -= b.max(0)
            own, flat = (target[i:j] - lo) * (j - i) + np.arange(j - i), b.reshape(-1)
            out[i:j] += flat[own]
            np.exp(b, out=b)
            total = b.sum(0)
            out[i:j] -= np.log(total)
            if grad is not None:
                b /= total
                flat[own] -= 1
                by_word[lo:hi] = b @ hk.T
                d[:, i:j] += w[:, :-1].T @ b
        if grad is not None:
            grad["wo"] += by_word[:, :-1]
            grad["bo"] += by_word[:, -1]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out[back], None if d is None else d.take(back, 1).T

    def window(self, ids: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray, over: float | None = None) -> tuple[float, dict, np.ndarray]:
        """One window of all streams, [steps, streams], targets below 0 being none: its log-likelihood, the gradients of the loss over `over` (the mean by default), and the state it ends with."""
        p, n, (steps, streams) = self.p, self.hidden, ids.shape
        gates, kind = self.gates(), h.dtype
        kept, states = [], np.empty((n, steps, streams), kind)
        for t in range(steps):
            h = h.T * fresh[t]
            new, *rest = (v.T for v in self.step(np.asfortranarray(gates.take(ids[t], 0)), h.T))
            kept.append((h, *rest))
            states[:, t] = new
            h = new.T
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        states, goal = states.reshape(n, -1), target.ravel()
        some = np.flatnonzero(goal >= 0)
        if len(some) == len(goal):
            scores, d = self.losses(states.T, goal, grad)
            d = d.T
        else:
            scores, back = self.losses(states.take(some, 1).T, goal[some], grad)
            d = np.zeros_like(states)
            d[:, some] = back.T
        d = d.reshape(n, steps, streams)
        # what flows back into the candidate behind its gate, z, r and the candidate
        flow, own = np.empty((steps, 4 * n, streams), kind), np.empty_like(d)
        u, gu = np.concatenate([p["u"][:, 2 * n :], p["u"][:, : 2 * n]], 1), np.zeros((n, 3 * n), kind)
        gx = np.zeros((3 * n, n), kind)
        back = np.zeros((n, streams), kind)
        for t in range(steps - 1, -1, -1):
            before, z, r, an, c = kept[t]
            back += d[:, t]
            dan, dz, dr, dc = flow[t].reshape(4, n, streams)
            keep = (1 - z) * back
            np.multiply(keep, 1 - c * c, out=dc)
            np.multiply(before - c, z, out=dz)
            dz *= keep
            np.multiply(dc, r, out=dan)
            np.multiply(dan, an, out=dr)
            dr *= 1 - r
            da = flow[t, : 3 * n]
            gu += before @ da.T
            dx = flow[t, n:]
            gx += dx @ p["embed"].take(ids[t], 0)
            own[:, t] = p["wx"] @ dx
            back *= z
            back += u @ da
            back *= fresh[t]
        grad["u"] += np.concatenate([gu[:, n:], gu[:, :n]], 1)
        total = flow.sum(2).sum(0)
        grad["wx"] += gx.T
        grad["bn"] += total[:n]
        grad["bx"] += total[n:]
        word, size = ids.ravel(), len(p["embed"])
        # the commonest in turn in eight places, as a sum need not wait for the one before
        word = np.where(word < 2, size + np.arange(len(word)) % 8 * 2 + word, word)
        by_word = np.stack([np.bincount(word, x.ravel(), size + 16) for x in own])
        by_word[:, :2] += by_word[:, size:].reshape(-1, 8, 2).sum(1)
        grad["embed"] += by_word[:, :size].T
        for v in grad.values():
            v /= over or max(1, len(some))
        return float(scores.sum()), grad, h

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], moments: dict, rate: float = RATE) -> tuple[float, int]:
        """One pass over texts (ids and where each begins, as _tokens() has them) with Adam: their log-likelihood and tokens. moments is kept between calls."""
        h, total, tokens, full = None, 0.0, 0, 1
        flat = self.flat()
        self.load(flat)
        m, v = (moments.setdefault(k, np.zeros_like(flat)) for k in ("m", "v"))
        for ids, target, fresh, kept in windows(batches):
            if h is None:
                h, full = np.zeros((ids.shape[1], self.hidden), np.float32), ids.size
            score, grad, h = self.window(ids, target, fresh, h[kept] if len(kept) < len(h) else h, full)
            total, tokens = total + score, tokens + int((target >= 0).sum())
            g = np.concatenate([x.ravel() for x in grad.values()])
            norm = float(np.sqrt(g @ g))
            k = moments["steps"] = moments.get("steps", 0) + 1
            size = np.float32(rate / (1 + k / 2000) * np.sqrt(1 - 0.99**k) / (1 - 0.9**k))
            g *= np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.01)
            v *= np.float32(0.99)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= size
            flat -= g
        return total, tokens

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-likelihood of each text's words and its end, the words of text i being ids[first[i]:first[i + 1]]."""
        order = np.argsort(-np.diff(first), kind="stable")
        out, gates = np.zeros(len(order)), self.gates()
        for a in range(0, len(order), TEXTS):
            part = order[a : a + TEXTS]
            out[part] = self._score(ids, first[part], first[part + 1] - first[part], gates)
        return out

    def _score(self, ids: np.ndarray, begin: np.ndarray, length: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """score() of texts of which each is as long as the next or longer."""
        out, h = np.zeros(len(length)), np.zeros((self.hidden, len(length)), np.float32)
        active = np.searchsorted(-length, -np.arange(int(length[0]) + 1), "right")  # texts with t words or more
        edge = np.concatenate([[0], np.cumsum(active)])
        current, t = np.full(len(length), END, np.int32), 0
        while t < len(active):
            # steps of about AT_ONCE tokens in all: their words, a step after the other
            to = max(t + 1, int(np.searchsorted(edge, edge[t] + AT_ONCE, "right")) - 1)
            at, row = edge[t : to + 1] - edge[t], np.arange(edge[t], edge[to]) - np.repeat(edge[t:to], active[t:to])
            word = np.repeat(np.arange(t, to), active[t:to])
            inside = word < length[row]
            target = np.full(len(row), END, np.int32)
            target[inside] = ids[(begin[row] + word)[inside]]
            source = np.concatenate([current[: active[t]], *(target[a : a + n] for a, n in zip(at.tolist(), active[t + 1 : to].tolist()))])
            x, states = gates.take(source, 0), np.empty((self.hidden, at[-1]), np.float32)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                h = self.step(np.asfortranarray(x[a:b]), h[:, : b - a].T)[0].T
                states[:, a:b] = h
            out[: active[t]] += np.bincount(row, self.losses(states.T, target)[0], active[t])
            current, t = target[at[-2] :], to
        return out


def _tokens(column: pa.Array, lexicon: Lexicon, spell: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows, where each row's begin, and the log-probability of its spellings, capitals and what stands between its words."""
    ids, sizes, spelled = [], [], []
    for b in slices(pa.RecordBatch.from_arrays([column], names=["text"])):
        w = Words(b.column(0))
        i = lexicon.ids(w)
        ids.append(i)
        sizes.append(np.diff(w.first))
        if spell:
            spelled.append(lexicon.spelled(w, i) + lexicon.rest(w, b.column(0)))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(ids, np.int32), np.concatenate([[0], np.cumsum(join(sizes, np.int64))]), join(spelled, float)


def sequence(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another: inputs (the end, then the words), targets (the words, then the end), and where each text begins, and the last ends."""
    count = np.diff(first)
    n = len(ids) + len(count)
    source, target = np.full(n, END, np.int32), np.full(n, END, np.int32)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)
    target[place], source[place + 1] = ids, ids
    return source, target, first + np.arange(len(first))


def windows(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, targets (below 0 where a stream has no more), 0 where a text begins, each [steps, streams]; and which of the streams before are still there.

    A stream takes one text after the other, whole, the longest of a batch first; what is left of a batch goes on with the next one.
    There are WINDOW steps, more when only few long texts are left.
    """
    batches = iter(batches)
    source = target = np.zeros(0, np.int32)
    at = end = np.zeros(0, np.int64)
    queue, ahead, streams, more = [], 0, 0, True
    while True:
        while more and ahead < max(streams, 1) * WINDOW:
            batch = next(batches, None)
            if batch is None:
                more = False
                break
            x, y, first = sequence(*batch)
            left = [*zip(at.tolist(), end.tolist()), *queue]
            size = np.cumsum([0] + [b - a for a, b in left])
            source, target = (np.concatenate([*(old[a:b] for a, b in left), new]) for old, new in ((source, x), (target, y)))
            at, end = size[: len(at)], size[1 : len(at) + 1]
            fresh_texts = sorted(zip((first[:-1] + size[-1]).tolist(), (first[1:] + size[-1]).tolist()), key=lambda t: t[0] - t[1])
            queue = [*zip(size[len(at) : -1].tolist(), size[len(at) + 1 :].tolist()), *fresh_texts]
            ahead = sum(b - a for a, b in queue)
            if not streams and queue:
                streams = min(STREAMS, len(queue))
                at = end = np.zeros(streams, np.int64)
        kept = np.arange(len(at))
        if not more and not queue:  # streams end
            kept = np.flatnonzero(at < end)
            at, end = at[kept], end[kept]
        if not len(at):
            return
        # the last, long texts go in few streams: longer windows, so that their number doesn't grow
        length = WINDOW if more or queue else WINDOW * min(16, max(1, streams // len(at)))
        steps = np.arange(length)[:, None]
        place = np.minimum(at + steps, len(source) - 1)
        inside = at + steps < end
        ids, goal, fresh = source[place], np.where(inside, target[place], -1), np.ones((length, len(at)), np.float32)
        at = at + length
        short, taken = np.flatnonzero(at >= end), 0
        for k in short.tolist():
            t = length - int(at[k] - end[k])
            at[k] = end[k]
            while t < length and taken < len(queue):
                a, b = queue[taken]
                taken += 1
                n = min(length - t, b - a)
                ids[t : t + n, k], goal[t : t + n, k], fresh[t, k] = source[a : a + n], target[a : a + n], 0
                t, at[k], end[k] = t + n, a + n, b
                ahead -= b - a
        queue = queue[taken:]
        yield ids, goal, fresh, kept


def train(docs: DataFrame, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, hidden: int = HIDDEN) -> Network:
    """docs: with a column text."""
    network = Network(lexicon(docs, vocabulary), hidden)
    size = network.flat().size
    for turn in range(rounds):
        part = docs.select("text").where(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(rounds)) == turn)

        def replica(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = (_tokens(b.column(0), network.lexicon, False)[:2] for b in batches if b.num_rows)
            seen = network.train(texts, {})[1]
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([network.flat().tobytes()], pa.binary())], names=["tokens", "flat"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, weight = np.zeros(size), 0.0
            for b in batches:
                for w, x in zip(b.column(0).to_pylist(), b.column(1)):
                    total += w * np.frombuffer(x.as_buffer(), np.float32)
                    weight += w
            if weight:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["tokens", "flat"])

        schema = "tokens double, flat binary"
        replicas = cut(part.mapInArrow(lean(replica), schema), "replicas")
        some = max(1, replicas.count() // FAN)
        means = replicas.repartition(some).mapInArrow(lean(average), schema).repartition(1).mapInArrow(lean(average), schema).collect()
        if means:
            network.load(np.frombuffer(means[0].flat, np.float32))
        drop(replicas)
    return network


def score(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """doc_id, n_tokens (words and the end), log_likelihood (natural), bits_per_token and bits_per_byte (null for empty texts) of each row."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = network or train(narrow, **options)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, most=SCORED_BYTES):
                ids, first, spelled = _tokens(b.column(1), model.lexicon, True)
                n, size = np.diff(first) + 1, pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
                bits = -(model.score(ids, first) + spelled) / np.log(2)
                by_byte = pa.array(bits / np.maximum(size, 1), mask=size == 0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(-bits * np.log(2)), pa.array(bits / n), by_byte], names=["doc_id", "n_tokens", "log_likelihood", "bits_per_token", "bits_per_byte"])

    return narrow.mapInArrow(lean(kernel), "doc_id long, n_tokens long, log_likelihood double, bits_per_token double, bits_per_byte double")
