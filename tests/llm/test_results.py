"""Results against brute force, exact round trips and held-out rows."""

import gzip
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_data import SF, VOCABULARY, sentence
from pyspark.sql import functions as F

from graftwork.llm import components, decontaminate, embeddup, langid, lm, mixing, neardup, queries, secrets, tokens, toxicity, warc
from graftwork.llm.batches import Words, mix



# 1


def test_kernel_sums_subsequences():
    """A word's decision against all choices of four letters within the span."""
    from itertools import combinations

    letters = toxicity.Letters(pa.array(["abcadeb facade"]))
    weights = np.random.default_rng(4).standard_normal(toxicity.CODES).astype(np.float32)
    got, norms = letters.fold(weights), letters.norms()
    assert len(got) == 2
    ends = [*letters.first[1:], len(letters.symbol)]
    for k, (lo, hi) in enumerate(zip(letters.first, ends)):
        s = letters.symbol[lo:hi].tolist()
        total = square = 0.0
        for i in combinations(range(len(s)), 4):
            span = i[-1] - i[0] + 1
            if span <= toxicity.SPAN:
                code = 0
                for j, x in enumerate(i):
                    h = int(mix(np.array([s[x] * 2 + j // 2], np.uint64))[0])
                    code ^= (h >> 32 * (j % 2)) % toxicity.CODES
                total += weights[code] * toxicity.DECAY**span
                square += toxicity.DECAY ** (2 * span)
        assert norms[k] == pytest.approx(math.sqrt(square), rel=1e-5) and got[k] == pytest.approx(total / math.sqrt(square), rel=1e-3)


def test_toxicity_finds_gapped_insults(spark):
    g = random.Random(3)
    insults = ["grozzlepate", "snarkfubber", "blistoad"]
    docs, marks = [], []
    for i in range(400):
        text = [sentence(g, 12) for _ in range(5)]
        if i % 4 == 0:
            for k in (1, 3):
                w = text[k].split()
                w.insert(g.randrange(len(w)), g.choice(insults))
                text[k] = " ".join(w)
        docs.append((i, " ".join(text)))
        marks.append((i, int(i % 4 == 0)))
    for j, shown in enumerate(["groz-zle-pate", "snarkxfubber", "b.l.i.s.t.o.a.d", "grozzlepate", "blistoad"]):
        docs.append((1000 + j, f"{sentence(g, 12)} You {shown} and {shown}! {sentence(g, 12)} Such a {shown}."))
    docs += [(2000 + j, " ".join(sentence(g, 12) for _ in range(5))) for j in range(200)]
    got = {r.doc_id for r in toxicity.detect(spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame(marks, "doc_id LONG, toxic INT")).collect()}
    assert len(got & set(range(1000, 1005))) >= 4
    assert sum(i in got for i in range(0, 400, 4)) >= 90
    assert sum(i >= 2000 or i < 400 and i % 4 > 0 for i in got) <= 5


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    got = {r.doc_id for r in toxicity.detect(docs, seen).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    toxic, clean = [r.doc_id for r in rest if r.toxic], [r.doc_id for r in rest if not r.toxic]
    assert sum(i in got for i in toxic) >= 0.8 * len(toxic)
    assert sum(i in got for i in clean) <= 0.01 * len(clean)


# 2


@pytest.mark.parametrize("name", ["plain", "gzip"])
def test_warc_pushdown(spark, tmp_path, name):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    path = f"file://{tmp_path}/{name}"
    warc.write(warc.page_records(pages), path, requests="true", **({"compression": "none"} if name == "plain" else {}))
    whole = warc.read(spark, path)
    counts = {r.warc_type: r["count"] for r in whole.groupBy("warc_type").count().collect()}
    assert counts["response"] == pages.count() == counts["request"]
    some = whole.where("warc_type = 'response' and target_uri like 'https%'")
    assert some.count() == pages.where("url like 'https%'").count()
    assert {r.m for r in some.select(F.md5("payload").alias("m")).collect()} == {r.m for r in pages.where("url like 'https%'").select(F.md5("html").alias("m")).collect()}
    assert warc.read(spark, path, payload="false").where("payload is not null").count() == 0
    assert warc.read(spark, path, splitBytes="1000").where("warc_type = 'response'").count() == pages.count()


def _warc_file(path, records, whole_member):
    blocks = [f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {len(r)}\r\n\r\n".encode() + r + b"\r\n\r\n" for i, r in enumerate(records)]
    path.write_bytes(gzip.compress(b"".join(blocks)) if whole_member else b"".join(blocks))
    return blocks


def test_warc_many_records_to_a_member(spark, tmp_path):
    records = [b"a", b"", b"x" * 700_000, b"line\r\n\r\nWARC/1.1\r\n", b"last"]
    _warc_file(tmp_path / "a.warc.gz", records, True)
    got = {r.record_id: bytes(r.payload) for r in warc.read(spark, str(tmp_path / "a.warc.gz"), mode="failfast").collect()}
    assert got == {f"<urn:x:{i}>": r for i, r in enumerate(records)}
    assert warc.read(spark, str(tmp_path / "a.warc.gz")).where("content_length > 3").count() == 3


def test_warc_goes_on_after_damage(spark, tmp_path):
    blocks = _warc_file(tmp_path / "a.warc", [b"one", b"two", b"three", b"four"], False)
    blocks[1] = blocks[1].replace(b"Content-Length: 3", b"Content-Length: ?")
    (tmp_path / "a.warc").write_bytes(b"".join(blocks))
    assert [bytes(r.payload) for r in warc.read(spark, str(tmp_path / "a.warc")).collect()] == [b"one", b"three", b"four"]
    with pytest.raises(Exception, match="no length"):
        warc.read(spark, str(tmp_path / "a.warc"), mode="failfast").collect()
    members = [warc.member(b) for b in blocks]
    members[2] = members[2][:40] + b"\0" * 8 + members[2][48:]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(members))
    assert b"four" in [bytes(r.payload) for r in warc.read(spark, str(tmp_path / "b.warc.gz")).collect()]


# 3


def _embedding_classes(rows):
    """Least id by id of the components of all pairs, by brute force; equal ids are one."""
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= embeddup.LEAST, 1))):
        a, b = root(rows[i][0]), root(rows[j][0])
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def test_embeddings_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    g = np.random.default_rng(6)
    near = []
    for k, r in enumerate(rows):
        x = np.array(r.embedding)
        for j in range(k % 4):  # copies with noise about the threshold
            near.append((100_000 + 4 * k + j, (x + g.standard_normal(len(x)) * np.linalg.norm(x) / math.sqrt(len(x)) * (0.1 + 0.1 * j)).tolist()))
    rows = [tuple(r) for r in rows] + near
    rows += [(200_000 + k, rows[5][1]) for k in range(300)]  # equal vectors
    rows += [(300_000 + k, (np.array(rows[9][1]) + g.standard_normal(64) * 0.01).tolist()) for k in range(300)]
    v = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    want, got = _embedding_classes(v.collect()), {r.vec_id: r for r in embeddup.classes(v).collect()}
    sizes = Counter(want.values())
    linked = [i for i in want if sizes[want[i]] > 1]
    assert len(got) == len(want) and len(linked) > 900
    assert sum(got[i].class_id == want[i] for i in want) >= 0.98 * len(want) and sum(got[i].class_id == want[i] for i in linked) >= 0.98 * len(linked)
    assert got[200_000].members == Counter(r.class_id for r in got.values())[got[200_000].class_id] >= 300


def test_embeddings_in_hot_cells(spark, monkeypatch):
    """The same where the largest class of a cell is spread over tasks."""
    monkeypatch.setattr(embeddup, "CHUNK", 7)
    g = np.random.default_rng(8)
    rows = [(k, g.standard_normal(16).tolist()) for k in range(60)]
    rows += [(100 + k, (np.array(rows[k % 3][1]) + g.standard_normal(16) * 0.12).tolist()) for k in range(150)]
    v = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    want, got = _embedding_classes(v.collect()), {r.vec_id: r.class_id for r in embeddup.classes(v).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


# 4


def test_reparameterised_questions(spark):
    item = "A train leaves Boston at 60 miles per hour and another leaves Chicago at 45 miles per hour, so how many hours pass until both have covered 500 miles together on the track."
    docs = [
        (1, "Intro words here. " + item + " Outro."),
        (2, item.replace("60 miles", "75 kilometers").replace("45 miles", "30 kilometers").replace("500 miles", "900 kilometers").replace("Boston", "Paris").replace("Chicago", "Rome")),
        (3, "The weather was mild and the garden grew well while nobody looked after the old roses by the wall."),
        (4, item.replace("45", "60")),  # different values of the item stand against one: another question
    ]
    got = {r.doc_id: r for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame([(7, item)], "item_id LONG, text STRING")).collect()}
    assert {1, 2} <= set(got) and 3 not in got
    assert got[1].reparameterised == 0 and got[2].reparameterised > 0 and got[1].covered == 1.0


def test_benchmark_passages_against_search(spark, documents, benchmark):
    """Whoever holds an item's words in a row, found by a search for the words, must be reported."""
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in benchmark.collect()]
    want = {(r.doc_id, i) for r in documents.collect() for i, t in items if t in plain(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, benchmark).collect()}
    assert want and want <= got
    assert len({d for d, _ in got}) <= 0.3 * documents.count()


# 5


def test_weights_reach_their_targets():
    tokens_of = {"a": 1_000_000, "b": 50_000, "c": 1_000}
    a, w = mixing.weights(tokens_of, entropy=0.8, repeats=1e9)
    assert 0 <= a <= 1 and sum(w.values()) == pytest.approx(1)
    assert -sum(x * math.log(x) for x in w.values()) >= 0.8 * math.log(3) - 1e-9
    finer = [k / 10_000 for k in range(10_001)]
    share = [n / 1_051_000 for n in tokens_of.values()]

    def entropy(e):
        p = [s**e for s in share]
        return -sum(x / sum(p) * math.log(x / sum(p)) for x in p)

    assert a == pytest.approx(max(e for e in finer if entropy(e) >= 0.8 * math.log(3)), abs=2e-4)
    _, w = mixing.weights(tokens_of, entropy=1.0, repeats=2.0)
    assert all(w[s] * 1_051_000 <= 2.0 * n + 1 for s, n in tokens_of.items())


def test_budgets(documents):
    n = {r.source: r.n for r in documents.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("n")).collect()}
    _, w = mixing.weights(n)
    total = sum(n.values())
    got = mixing.mix(documents)
    used = {r.source: r.n for r in got.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("n")).collect()}
    longest = max(r.n for r in documents.select(mixing.tokens_of(F.col("text")).alias("n")).collect())
    for s, x in w.items():
        assert x * total - 2 * longest <= used.get(s, 0) <= x * total + 2 * longest
    assert got.where("position < 0 or position >= 1").count() == 0
    again = sorted((r.doc_id, r.epoch, r.position) for r in mixing.mix(documents.repartition(7)).collect())
    assert again == sorted((r.doc_id, r.epoch, r.position) for r in got.collect())


def test_mixture_by_hand(spark):
    """Blocks, epochs, the budget's end and positions recomputed row by row."""
    g = random.Random(7)
    rows = [(i, sentence(g, g.randrange(1, 30)), "big") for i in range(150)] + [(200 + i, sentence(g, 12), "small") for i in range(4)] + [(300, sentence(g, 900), "one")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    blocks, seed, budget = 8, 1, 1500
    got = {(r.doc_id, r.epoch): r for r in mixing.mix(docs, budget=budget, blocks=blocks).collect()}
    marks = docs.select("source", "doc_id", mixing.tokens_of(F.col("text")).alias("n"), *[F.xxhash64(F.lit(seed + k), F.col("doc_id"), F.xxhash64("text")).alias(f"h{k}") for k in (0, 1)]).collect()
    tokens = Counter()
    for r in marks:
        tokens[r.source] += r.n
    _, weight = mixing.weights(dict(tokens), budget=budget)
    want = {}
    for source in tokens:
        own, room = [r for r in marks if r.source == source], int(weight[source] * budget)
        epochs, rest = divmod(room, tokens[source])
        for e in range(epochs):
            want |= {(r.doc_id, e): r for r in own}
        order = spark.range(blocks).select("id", F.xxhash64(F.lit(seed + 2), F.lit(source), F.col("id").cast("int"), F.lit(epochs).cast("long")).alias("h")).collect()
        taken = 0
        for b in sorted(order, key=lambda b: (b.h, b.id)):
            inside = [r for r in own if r.h0 % blocks == b.id]
            n = sum(r.n for r in inside)
            if taken + n <= rest:
                want |= {(r.doc_id, epochs): r for r in inside}
                taken += n
            elif taken < rest:
                inside, some = sorted(inside, key=lambda r: r.h1), 0
                for r in inside:
                    if taken + some + r.n > rest:
                        break
                    want[r.doc_id, epochs] = r
                    some += r.n
                if not epochs and not any(x.source == source for x in want.values()):
                    want[inside[0].doc_id, epochs] = inside[0]
                break
    assert set(got) == set(want) and {r.source for r in got.values()} == {"big", "small", "one"}
    assert all(r.block == want[k].h0 % blocks and 0 <= r.position < 1 for k, r in got.items())
    by_source = {s: sorted((r.position, r.epoch) for r in got.values() if r.source == s) for s in tokens}
    assert all([e for _, e in v] == sorted(e for _, e in v) for v in by_source.values())  # an epoch after the other


# 6


def test_network_is_a_distribution_and_learns(spark):
    g = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"{g.choice('abc')}x then" for _ in range(40))) for i in range(60)], "doc_id LONG, text STRING")
    net = lm.train(docs, vocabulary=20, rounds=2, hidden=16)
    h = np.random.default_rng(0).standard_normal((1, net.hidden)).astype(np.float32)
    total = sum(float(np.exp(net.losses(h, np.array([k]))[0][0])) for k in range(net.lexicon.size))
    assert total == pytest.approx(1, abs=1e-4)
    new = lm.Network(net.lexicon, 16)
    loss = lambda m: sum(r.log_likelihood for r in lm.score(docs, m).collect())
    assert loss(net) > loss(new)
    each = {r.doc_id: r.log_likelihood for r in lm.score(docs, net).collect()}
    alone = lm.score(docs.where("doc_id = 5"), net).first().log_likelihood
    assert alone == pytest.approx(each[5], rel=1e-4)  # the state goes through whole documents, whatever else is in the batch


def test_scores_are_steps_in_a_row(spark):
    """A document's score against the network stepped by hand, token by token."""
    docs = spark.createDataFrame([(1, "one two three one two nine")], "doc_id LONG, text STRING")
    net = lm.train(docs, vocabulary=10, rounds=1, hidden=8)
    ids, first, spelled = lm._tokens(pa.array(["one two three one two nine"]), net.lexicon, True)
    x, y, _ = lm.sequence(ids, first)
    h, total = np.zeros((1, 8), np.float32), float(spelled[0])
    for a, b in zip(x, y):
        h = net.step(net.gates()[[a]], h)[0]
        total += float(net.losses(h, np.array([b]))[0][0])
    assert lm.score(docs, net).first().log_likelihood == pytest.approx(total, rel=1e-4)


def test_streams_take_every_token(monkeypatch):
    """Windows of streams hold each text whole, in order, and nothing else."""
    monkeypatch.setattr(lm, "STREAMS", 5)
    g = np.random.default_rng(2)
    texts = [g.integers(2, 90, n).astype(np.int32) for n in [0, 1, 15, 16, 17, 300, 3, 0, 40] * 6]
    batches = [(np.concatenate([*part, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)) for part in (texts[:3], [], texts[3:40], texts[40:])]
    lines, got = None, []
    for ids, target, fresh, kept in lm.windows(iter(batches)):
        lines = [[] for _ in kept] if lines is None else [lines[k] for k in kept]
        for k, line in enumerate(lines):
            for x, y, f in zip(ids[:, k], target[:, k], fresh[:, k]):
                if y >= 0:
                    if f == 0:
                        line.clear()
                    assert x == (line[-1] if line else lm.END)
                    line.append(int(y))
                    if y == lm.END:
                        got.append(tuple(line[:-1]))
    assert sorted(got) == sorted(tuple(t.tolist()) for t in texts)


def test_backpropagation_against_differences():
    hashes = np.arange(1, 13, dtype=np.uint64)
    lexicon = lm.Lexicon(hashes, np.arange(12, 0, -1), 5, 100, np.ones((256, 256)), np.ones((256, 256)), np.ones(4))
    net, g = lm.Network(lexicon, 5), np.random.default_rng(3)
    net.p = {k: g.standard_normal(v.shape) * 0.5 for k, v in net.p.items()}  # in double precision
    ids, target = (g.integers(0, lexicon.size, (6, 3)).astype(np.int32) for _ in range(2))
    target[4:, 1] = -1
    fresh = np.ones((6, 3))
    fresh[0], fresh[3, 2] = 0, 0
    h = np.zeros((3, 5))
    _, grad, _ = net.window(ids, target, fresh, h)
    n = (target >= 0).sum()
    for name, x in net.p.items():
        for at in {tuple(int(g.integers(0, d)) for d in x.shape) for _ in range(12)}:
            was, step = x[at], 1e-4
            x[at] = was + step
            up = net.window(ids, target, fresh, h)[0]
            x[at] = was - step
            down = net.window(ids, target, fresh, h)[0]
            x[at] = was
            assert grad[name][at] == pytest.approx(-(up - down) / (2 * step) / n, abs=2e-4, rel=2e-2), (name, at)


def test_all_bytes_are_scored():
    """What stands between words and their capitals, by hand."""
    texts = ["", "a b", " (One) TWO, mcX!", "?!", "\u00c9t\u00e9 \u0130x"]
    column = pa.array(texts)
    words = lm.Words(column)
    gaps = np.random.default_rng(5).integers(1, 50, (256, 256))
    lexicon = lm.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1, np.ones((256, 256)), gaps, np.array([5, 3, 2, 1]))
    got = lexicon.rest(words, column)
    p = (gaps + 0.01) / (gaps + 0.01).sum(1, keepdims=True)
    case = (np.array([5, 3, 2, 1]) + 1) / 15
    for i, t in enumerate(texts):
        parts = re.split(r"[^\W_]+", t)
        want = sum(math.log(p[a, b]) for gap in parts for a, b in zip(b"\0" + gap.encode(), gap.encode() + b"\0"))
        for w in re.findall(r"[^\W_]+", t):
            upper = [c != c.lower() for c in w]
            kind = 0 if not any(upper) else 1 if upper[0] and sum(upper) == 1 else 2 if all(upper) else 3
            want += math.log(case[kind]) - (len(w) * math.log(2) if kind == 3 else 0)
        assert got[i] == pytest.approx(want, rel=1e-5), t
    pair, _, *ends = lm.between(words)
    every = sum(np.bincount(x + 1, minlength=65537) for x in (pair, *ends))[1:]
    assert every.sum() == sum(len(g) + 1 for t in texts for g in re.split(r"[^\W_]+", t))


def test_junk_scores_lower_than_prose(documents):
    docs = documents.where("text is not null and length(text) > 200").limit(150)
    net = lm.train(docs, vocabulary=300, rounds=1, hidden=16)
    text = docs.first().text
    junk = text.replace(" ", " #$%^ ")
    spark = docs.sparkSession
    a, b = (lm.score(spark.createDataFrame([(1, t)], "doc_id LONG, text STRING"), net).first().log_likelihood for t in (text, junk))
    assert b < a


# 7


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 100")
    models = langid.train(docs.where("doc_id % 2 = 0"))
    got = langid.identify(docs, models).join(docs.where("doc_id % 2 = 1").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert sum(r.nearest == r.lang for r in got) >= 0.95 * len(got)
    assert sum(not r.accepted for r in got) <= 0.03 * len(got) + 1


def test_language_rejects_noise(documents):
    models = langid.train(documents)
    g = random.Random(2)
    noise = pa.array(["".join(chr(g.randrange(33, 127)) for _ in range(400)) for _ in range(20)])
    assert sum(models.decide(noise)[2]) <= 2


def _kneser_ney_by_hand(text, order, base):
    """Interpolated Kneser-Ney with dictionaries: a function of context and symbol."""
    sequence = "\0" * (order - 1) + re.sub(r"\s", " ", re.sub(r"[0-9]", "0", text.lower()))
    counts = {order: Counter(sequence[i - order + 1 : i + 1] for i in range(order - 1, len(sequence)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def probability(context, symbol):
        k = len(context) + 1
        c = counts[k]
        ones, twos = (sum(v == n for v in c.values()) for n in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        lower = probability(context[1:], symbol) if k > 1 else base
        around = {g: v for g, v in c.items() if g[:-1] == context}
        if not around:
            return lower
        total = sum(around.values())
        return (max(c[context + symbol] - d, 0) if context + symbol in c else 0) / total + d * len(around) / total * lower

    return probability


def test_kneser_ney_by_dictionaries():
    texts = {"a": "The cat sat on the mat. The rat sat at 12 and 7.", "b": "\u6f22\u5b57\u4eee\u540d\u4ea4\u3058\u308a\u6587 \u6f22\u5b57 \U00020000\U00020000"}
    models = langid.Models({k: [t] for k, t in texts.items()})
    symbols = {c for t in texts.values() for c in re.sub(r"[0-9]", "0", t.lower())}
    base = 1 / (len(symbols) + 1)
    for probe in ("the hat", "That 99 zebras", "\u6f22\u5b57 cat", "\U00020000\u540d", "q"):
        got = models.bits(pa.array([probe]))[0][0]
        line = "\0" * (langid.ORDER - 1) + re.sub(r"[0-9]", "0", probe.lower())
        for j, lang in enumerate(models.langs):
            p = _kneser_ney_by_hand(texts[lang], langid.ORDER, base)
            want = -sum(math.log2(p(line[i - langid.ORDER + 1 : i], line[i])) for i in range(langid.ORDER - 1, len(line))) / len(probe)
            assert got[j] == pytest.approx(want, rel=1e-4), (probe, lang)


def test_languages_of_one_script(spark):
    """Texts whose characters differ only beyond the commonest few hundred."""
    g = random.Random(4)
    shapes = {lang: [chr(0x4E00 + at + i) for i in range(1500)] for lang, at in (("x", 0), ("y", 1000), ("z", 2000))}
    rows = [(i, "".join(g.choice(shapes[lang]) for _ in range(80)), lang) for i, lang in enumerate(g.choice("xyz") for _ in range(400))]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    models = langid.train(docs.where("doc_id < 300"))
    got = {r.doc_id: r.nearest for r in langid.identify(docs.where("doc_id >= 300"), models).collect()}
    assert sum(got[i] == lang for i, _, lang in rows if i >= 300) >= 95


# 8


def test_secrets_against_expressions_everywhere(spark):
    """The prefilter loses nothing: matches of every expression anywhere, validated and thinned alike."""
    rules = {k: re.compile(r[1]) for k, r in secrets.RULES.items()}
    words = secrets.automaton()
    n = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        text = r.text or ""
        every = []
        for kind, (keys, _, check, _) in secrets.RULES.items():
            for at in sorted({m.start() for k in keys for m in re.finditer(re.escape(k), text)}):
                m = rules[kind].match(text, at)
                if m and (kind == "assigned" or not at or not text[at - 1].isascii() or not text[at - 1].isalnum()):
                    g = "v" if "v" in m.re.groupindex else 0
                    if check is None or check(m[g]):
                        every.append((m.start(g), m.end(g), kind))
        every.sort(key=lambda x: (x[0], -x[1], x[2]))
        kept = []
        for x in every:
            if not kept or x[0] >= kept[-1][1]:
                kept.append(x)
        assert [x[:3] for x in secrets.find(text, words, rules)] == kept
        n += len(kept)
    assert n


def test_checksums():
    body = "A" * 30
    good, bad = f"ghp_{body}{secrets.crc62(body)}", f"ghp_{body}{'z' * 6}"
    words, rules = secrets.automaton(), {k: re.compile(r[1]) for k, r in secrets.RULES.items()}
    assert [x[2:] for x in secrets.find(f"a {good} b", words, rules)] == [("github_token", "valid")]
    assert secrets.find(f"a {bad} b", words, rules) == []
    assert [x[2] for x in secrets.find("IBAN: GB82 WEST 1234 5698 7654 32.", words, rules)] == ["iban"]
    assert secrets.find("IBAN: GB82 WEST 1234 5698 7654 33.", words, rules) == []


def test_keys_with_headers_and_vendors():
    words, rules = secrets.automaton(), {k: re.compile(r[1]) for k, r in secrets.RULES.items()}
    import base64

    body = base64.b64encode(bytes(range(64))).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert [x[2:] for x in secrets.find(f"x {pem} y", words, rules)] == [("private_key", "valid")]
    assert secrets.find(f"x {pem.replace('Proc-Type: 4,ENCRYPTED', 'Comment: none')} y", words, rules) == []
    assert [x[2] for x in secrets.find("SG." + "a1" * 11 + "." + "b2C" * 14 + "d, sk_test_" + "Ab12" * 5, words, rules)] == ["sendgrid_key", "stripe_key"]


# 9


def brute_groups(rows, least):
    """All pairs of texts by weighted Jaccard, with idf counted by hand; components by union."""
    words = Words(pa.array([t for _, t in rows]))
    features, counts, first = neardup.shingles(words)
    documents = len(rows)
    df = Counter(features.tolist())
    idf = {f: max(neardup.LEAST_IDF, math.log(documents / n)) for f, n in df.items()}
    vec = [{int(f): c * idf[int(f)] for f, c in zip(features[a:b], counts[a:b])} for a, b in zip(first[:-1], first[1:])]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = vec[i], vec[j]
            sa, sb = sum(a.values()), sum(b.values())
            if not a or not b or min(sa, sb) < least * max(sa, sb):
                continue
            low = sum(min(w, b[f]) for f, w in a.items() if f in b)
            if low >= least * (sa + sb - low):
                parent[root(i)] = root(j)
    sets: dict = {}
    for i, (d, _) in enumerate(rows):
        sets.setdefault(root(i), []).append(d)
    return [sorted(s) for s in sets.values() if len(s) > 1]


def test_near_duplicates_against_all_pairs(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = {(d, g[0]) for g in brute_groups(rows, neardup.LEAST) for d in g[1:]}
    got = {(r.doc_id, r.duplicate_of) for r in neardup.near_duplicates(documents).collect()}
    assert want and len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)
    assert neardup.deduplicate(documents).count() == documents.count() - len(got)


def test_idf_counts_all_shingles(spark, monkeypatch):
    """Sketched frequencies against counting, in 100 partitions of long documents; small, so that counters collide."""
    monkeypatch.setattr(neardup, "WIDTH", 1 << 20)
    g = random.Random(9)
    rows = [(i, " ".join(g.choice(VOCABULARY) for _ in range(g.choice((3, 300, 2000)))) + (" one passage that many of the documents share" if i % 3 else "")) for i in range(300)]
    features, _, first = neardup.shingles(Words(pa.array([t for _, t in rows])))
    df = Counter(features.tolist())
    idf = neardup.frequencies(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(100))
    own = np.array(sorted(df), np.uint64)
    got, want = idf.weights(own, np.ones(len(own))), np.array([max(neardup.LEAST_IDF, math.log(300 / df[f])) for f in own.tolist()])
    assert (got <= want + 0.01).all() and (np.abs(got - want) < 0.01).mean() > 0.8
    # too high by more than e / WIDTH of all shingles with a probability of e ** -ROWS at most
    assert (300 * (np.exp(-got) - np.exp(-want)) > math.e * len(features) / neardup.WIDTH + 0.6).mean() <= math.exp(-neardup.ROWS)


def test_a_group_of_many_copies(spark):
    g = random.Random(8)
    base = [sentence(g, 15) for _ in range(12)]
    rows = [(i, " ".join(base[:6] + [sentence(g, 3)] + base[6:])) for i in range(40)] + [(1000 + i, " ".join(sentence(g, 15) for _ in range(12))) for i in range(360)] + [(2000 + i, "the very same words in every one of these rows") for i in range(300)]
    got = {(r.doc_id, r.duplicate_of) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert got == {(i, 0) for i in range(1, 40)} | {(i, 2000) for i in range(2001, 2300)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}


# 10


def test_token_counts_are_exact(spark, documents):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    enc = tokens.Encoder(tokens.VOCABULARY)
    hard = ["word " * 5000, "x" * 20_000, " " * 9_000 + "end", "a1 b2\n\n\tc3 " * 900, "É à 漢字 " * 2000, "..!?" * 4000]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(hard)], "doc_id LONG, text STRING"))
    got = {r.doc_id: r for r in tokens.token_counts(docs, chunk=500, overlap=20).collect()}
    assert any(r.widened for r in got.values()) and any(r.chunks > 1 for r in got.values())
    whole = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, chunk=1 << 30).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == whole
    ranks = load_tiktoken_bpe(tokens.VOCABULARY)
    plain = tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        assert whole[r.doc_id] == len(plain.encode_ordinary(r.text))
    assert enc is not None


# all


def test_every_query_has_rows(spark):
    for name, f in queries.queries().items():
        got = f(spark, SF)
        assert got.columns and got.count() > 0 or name in ("op1_toxicity", "op8_secret_scan"), name  # nothing to find in so few rows


def test_pipeline_is_its_stages(spark):
    """Each stage's rows against the operator's own decisions on what it was given."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    accepted = {r.doc_id for r in langid.identify(docs).where("accepted").collect()}
    one = corpus_pipeline.identify_language(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == accepted
    two = corpus_pipeline.drop_near_duplicates(spark, one, SF)
    assert {r.doc_id for r in two.collect()} == accepted - {r.doc_id for r in neardup.near_duplicates(one).collect()}
    three = corpus_pipeline.drop_benchmark_leaks(spark, two, SF)
    bad = {r.doc_id for r in decontaminate.contaminated(two, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - bad
    four = corpus_pipeline.redact_secrets(spark, three, SF)
    assert secrets.scan(four).count() == 0 and four.count() == three.count()
    last = corpus_pipeline.run(spark, SF)
    assert last.columns == [*docs.columns, "epoch", "block", "position"]
    assert {r.doc_id for r in last.collect()} <= {r.doc_id for r in four.collect()}
    assert len(VOCABULARY) == 400
