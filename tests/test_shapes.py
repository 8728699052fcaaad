"""Texts that differ in the numbers of words only are compared once, and found as if each was."""

import snippets
from graftwork.engine import facts
from graftwork.engine.diff import diff, multi_file
from graftwork.operators import code
from graftwork.parse import parse
from graftwork.plans import generated

PAIR = "commit STRING, file_path STRING, lang STRING, old_text STRING, new_text STRING"
OLD = "fn work_{0}(p: i32) -> i32 {{\n    let v_{1} = other_{0}(p, 1_000);\n    if v_{1} >= 0 {{\n        return _{1};\n    }}\n    return v_{1};\n}}\n"
NEW = "fn work_{0}(p: i32) -> i32 {{\n    let v_{0} = other_{1}(p, 1_000);\n    return v_{0};\n}}\n\nfn more_{2}() {{ work_{0}(\"s_{2}\"); }}\n"
NUMBERS = [(1, 2, 3), (2, 1, 3), (7, 7, 7), (1, 1, 2), (12, 345, 12), (12, 345, 6789), (1, 10, 100), ("007", "7", "07")]


def commits():
    for k, n in enumerate(NUMBERS * 2):
        a, b = OLD.format(*n), NEW.format(*n)
        yield f"c_{k}", f"src/b_{k}.rs", "rust", a, b
        yield f"c_{k}", f"src/a_{k}.rs", "rust", b, a if k % 2 else None
    yield "odd", "src/z.rs", "rust", "fn f_314159265358979323000() { g_1(); }", "fn f_1() { g_2(); }"
    yield "odd", "src/y.rs", "rust", "fn f_2() { \"\0commit\0\"; }", "fn f_3() { \"\0commit\0\"; }"
    yield None, "src/n_1.rs", "rust", "fn f_2() {}", "fn f_3() {}"
    yield from snippets.PAIRS


def test_results_are_those_of_each_file(spark):
    rows = list(commits())
    df = spark.createDataFrame(rows, PAIR).coalesce(1)
    tree = lambda t, lang: None if t is None else parse(t, lang)
    want, want_flows = [], set()
    for c, p, lang, old, new in rows:
        if old != new:
            a, b = tree(old, lang), tree(new, lang)
            ops = diff(a, b)
            want.append(str((c, p, ops, facts.patterns(ops, a, b), facts.violations(p, a, b) if a and b else [])))
    got = [r.asDict(True) for r in code.file_diffs(df).collect()]
    assert sorted(str((r["commit"], r["file_path"], r["operations"], r["patterns"], r["violations"])) for r in got) == sorted(want)
    events, moves = [], []
    for c in {r[0] for r in rows}:
        sides = sorted((p, tree(a, lang), tree(b, lang)) for k, p, lang, a, b in rows if k == c and a != b)
        events += [str((c, *e.values())) for e in facts.cross_file(sides)]
        moves += [str((c, p, o)) for p, o in multi_file({p: a for p, a, _ in sides if a}, {p: b for p, _, b in sides if b}).items()]
    assert sorted(str(tuple(r)) for r in code.by_commit(df, events=True).collect()) == sorted(events)
    assert sorted(str((r["commit"], r["file_path"], r["operations"])) for r in (x.asDict(True) for x in code.by_commit(df, events=False).collect())) == sorted(moves)


def test_equal_shapes_are_made_once():
    shapes, made = code._Shapes(), []

    def look(old, new, commit):
        (a, b), fill = shapes.of([old, new])
        return shapes.found((a, b), fill | {"commit": commit}, lambda: made.append(a) or [("\0commit\0", a, {"x": [b, 1]})])

    for k in range(100):
        assert look(OLD.format(k, k + 1, 0), NEW.format(k, k + 1, 5), f"c{k}") == [(f"c{k}", OLD.format(k, k + 1, 0), {"x": [NEW.format(k, k + 1, 5), 1]})]
    assert len(made) <= 3  # numbers that are equal to others make other shapes
    assert shapes.of(["x" * (code.SHORT + 1)]) is None and shapes.of(["\0"]) is None


def test_parts_are_spread_before_they_are_text(spark, tmp_path):
    spark.createDataFrame([(k % 50, k % 13) for k in range(100)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pairs = generated.part_pairs(spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() > 4
    for part in pairs.rdd.glom().collect():  # a commit's rows follow each other
        commits = [r["commit"] for r in part]
        assert len(set(commits)) == sum(a != b for a, b in zip([None, *commits], commits))
