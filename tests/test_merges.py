"""Merges with comparisons that are kept are the same merges."""

from functools import lru_cache
from itertools import product

from graftwork.engine import merge as m
from graftwork.engine.diff import diff
from graftwork.operators import code

TEXTS = ('{"k": 1}', '{"k": 2}', '{"k": 1, "j": 3}', '{"j": 4}', "", None, '{"k":', "x" * 2_001)


def test_kept_comparisons(spark):
    asked = []
    tree = lru_cache(None)(m.parsed)
    compare = lru_cache(None)(lambda a, b, lang: asked.append((a, b)) or diff(tree(a, lang), tree(b, lang)))
    rows = [(f"p{i}", "json", *t) for i, t in enumerate(product(TEXTS, repeat=3))]
    want = {p: m.merge(a or "", b or "", c or "", p, lang) for p, lang, a, b, c in rows}
    assert {p: m.merge(a or "", b or "", c or "", p, lang, tree, compare) for p, lang, a, b, c in rows} == want
    assert len(asked) == len(set(asked)) <= (len(TEXTS) - 1) ** 2
    df = spark.createDataFrame(rows, "path STRING, lang STRING, base STRING, ours STRING, theirs STRING")
    assert {r.path: (r.merged, r.status) for r in code.merged(df).collect()} == want
