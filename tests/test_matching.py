"""Matching against brute force, and what it moves."""

from collections import Counter

from graftwork.operators import matching

LEFT = [(1, "a b c"), (2, "a a b"), (3, ""), (None, "a b"), (4, "x y"), (4, "z"), (5, "ärger q"), (6, None)]
RIGHT = [(10, "A, b c"), (11, "a a b b"), (12, None), (None, "a b c"), (13, "x"), (13, "y z z"), (14, "q Ärger"), (15, "nothing"), (16, "")]


def overlaps(left, right, at, by):
    def merged(rows):
        out = {}
        for k, t in rows:
            if k is not None and t is not None:
                out.setdefault(k, Counter()).update("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split())
        return {k: c for k, c in out.items() if c}

    for l, x in merged(left).items():
        for r, y in merged(right).items():
            shared, low = len(x.keys() & y.keys()), (x & y).total()
            union, most = len(x.keys() | y.keys()), (x | y).total()
            if "set" in by and shared / union >= at or "multiset" in by and low / most >= at:
                yield l, r, shared, union, low, most


def test_overlaps_are_those_of_all_pairs_and_shuffle_nothing_but_the_left_side(spark, monkeypatch):
    left = spark.createDataFrame(LEFT, "l long, text string")
    for right in (RIGHT, [r for r in RIGHT if r[0] != 13]):
        frame = spark.createDataFrame(right, "r long, text string")
        for by in (("set",), ("multiset",), ("set", "multiset")):
            for items, pairs in ((8_000, 1_000_000), (2, 1)):
                monkeypatch.setattr(matching, "BLOCK_ITEMS", items)
                monkeypatch.setattr(matching, "BLOCK_PAIRS", pairs)
                got = matching.overlap_scores(left, frame, 0.4, by)
                assert sorted(map(tuple, got.collect())) == sorted(overlaps(LEFT, right, 0.4, by))
                assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (right is RIGHT)
    none = matching.overlap_scores(left.limit(0), frame, 0.4)
    assert none.count() == 0 and none.columns == ["l", "r", "shared", "set_union", "sum_least", "sum_greatest"]


def test_extractions_compare_sets_of_words_once(spark, tmp_path):
    from graftwork.plans import snapshots

    names = ("red bolt", "bolt red", "red red bolt", "blue ring", "", None)
    parts = [(i, names[i % 6], f"B{i % 2}" if i % 17 else None, "LARGE" if i % 3 else "SMALL big", (5, 45, 20, 41, 10)[i % 5]) for i in range(240)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = snapshots.refactor_extract(spark, str(tmp_path))
    sets = {k: set(f"{n or ''} {t}".lower().split()) for k, n, _, t, _ in parts}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, _, x, t, s in parts for b, _, y, u, z in parts if x is not None and (x, t) == (y, u) and s > 40 and z <= 10}
    assert sorted(map(tuple, got.collect())) == sorted((a, b, c) for (a, b), c in want.items() if c > 0.8)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    compared = next(i for i, line in enumerate(plan) if "array_intersect" in line)
    assert sum("Aggregate" in line for line in plan[compared:]) >= 2


def test_nearest_sets_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    texts = []
    for k in range(60):
        base = rng.sample(range(400), rng.choice((1, 2, 5, 12, 40)))
        texts += [(f"w{x}" for x in base), (f"w{x}" for x in base[: max(1, len(base) * 9 // 10)]), (f"w{x}" for x in [*base, *rng.sample(range(400), 1 + len(base) // 5)])]
    texts = [sorted(set(t)) for t in texts]
    rows = [(i % 170, "ab"[i % 2] if i % 29 else None, t) for i, t in enumerate(texts + texts[:20] * 3)] + [(None, "a", texts[0]), (500, "a", [])]
    best = {}
    for i, x, s in rows:
        for j, y, t in rows:
            if None not in (i, j, x, y) and i != j and x == y and s and t:
                both = len(set(s) & set(t))
                if both >= 0.7 * (len(s) + len(t) - both):
                    best[i] = max(best.get(i, (0, 0)), (both / (len(s) + len(t) - both), j))
    got = matching.nearest_sets(spark.createDataFrame(rows, "id long, bucket string, words array<string>"), 0.7)
    assert {r.id: (r.similarity, r["match"]) for r in got.collect()} == best
    assert len(best) > 100


def test_copies_make_no_pairs(spark):
    rows = [(i, "a", ["x", "y", "z"]) for i in range(20_000)] + [(20_000, "a", ["x", "y", "z", "q"])]
    got = matching.nearest_sets(spark.createDataFrame(rows, "id long, bucket string, words array<string>"), 0.7)
    assert {r.id: r["match"] for r in got.collect()} == {i: 19_999 if i != 19_999 else 19_998 for i in range(20_001)}
