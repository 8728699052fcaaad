"""Trees, matching and facts, without Spark."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graftwork.engine import facts
from graftwork.engine.diff import diff, multi_file, name_of, significant
from graftwork.engine.merge import char_column, edit, merge, overlaps, point, reused
from graftwork.engine.similarity import composite, multiset, only_identifiers, penalty, score
from graftwork.parse import LANGUAGES, Limits, ParseLimit, parse
from graftwork.parse.node import COMMENTS

SOURCES = {
    "rust": ("fn f(a: i32) -> i32 {\n    let x = a + 1;\n    x\n}\n", "fn f(a: i32)->i32{ // note\n let x = a+1; x }\n"),
    "javascript": ("function f(a) {\n  const x = a + 1;\n  return x;\n}\n", "function f(a){ /* note */ const x = a+1; return x; }\n"),
    "python": ("def f(a):\n    x = a + 1\n    return x\n", "def f(a):\n    # note\n    x = (a+1)\n    return x\n"),
    "c": ("int f(int a) {\n  int x = a;\n  return x;\n}\n", "int f(int a){ /* note */ int x = a; return x; }\n"),
    "java": ("class A { int f(int a) { return a; } }", "class A {\n  // note\n  int f(int a) {\n    return a;\n  }\n}"),
    "go": ("package m\nfunc f(a int) int {\n\treturn a\n}\n", "package m\n// note\nfunc f(a int) int { return a }\n"),
    "typescript": ("interface I { a: string }\nfunction f(a: number): number { return a; }", "interface I {\n  a: string\n}\n// note\nfunction f(a: number): number {\n return a; }"),
    "cpp": ("class A { int f(int a) { return a; } };", "class A {\n  /* note */ int f(int a) { return a; }\n};"),
    "json": ('{"a": 1}', '{ // note\n "a": 1 }'),
}


def ops(old, new, lang="rust", **k):
    return [(o["op_type"], o["details"]) for o in diff(old and parse(old, lang, **k), new and parse(new, lang, **k))]


def kinds(old, new, lang="rust"):
    return [o for o, _ in ops(old, new, lang)]


@pytest.mark.parametrize("lang", SOURCES)
def test_format_and_comments_are_no_change(lang):
    assert ops(*SOURCES[lang], lang, logic_only=True) == []


@pytest.mark.parametrize("lang", SOURCES)
def test_trees_are_sound(lang):
    for text in SOURCES[lang]:
        root = parse(text, lang)
        nodes = list(root.walk())
        assert [n.id for n in nodes] == list(range(len(nodes))) and root.size == len(nodes)
        for n in nodes:
            assert 0 <= n.start <= n.end <= len(text.encode()) and not (n.text and n.children)
            assert n.kind not in ("ERROR", "MISSING")
        for n in nodes:
            inside = [m for m in nodes if n.id <= m.id < n.id + n.size]
            assert inside == list(n.walk())
    assert not any(n.kind in COMMENTS for n in parse(SOURCES[lang][1], lang, logic_only=True).walk())


def test_sides():
    src = "fn a() {}\nfn b() {}\n"
    assert diff(None, None) == []
    assert kinds(None, src) == ["INSERT"] * 2 and kinds(src, None) == ["DELETE"] * 2


def test_rename_move_modify():
    body = "{ let t = 1; t + 2 }"
    assert ("RENAME", "function_item renamed from 'old' to 'fresh'") in ops(f"fn old() {body}\nfn k() {{}}", f"fn fresh() {body}\nfn k() {{}}")
    assert "MOVE" in kinds(f"fn f() {body}\nstruct A {{ x: i32 }}", f"struct A {{ x: i32 }}\nimpl A {{ fn f() {body} }}")
    changed = ops("fn f() { let t = 1; g(t) }", "fn f() { let t = 1; if t == 2 { h(t) } }")
    assert ("MODIFY", "function_item 'f' modified") in changed and not any(k == "RENAME" for k, _ in changed)
    assert "INSERT" in kinds("fn f() { a(); b(); }", "fn f() { g(); }\nfn g() { a(); b(); }")


def test_reordering_is_no_operation():
    assert kinds("fn a() { x(); }\nfn b() { y(1); }", "fn b() { y(1); }\nfn a() { x(); }") == []


def test_literal_and_operator():
    a, b = parse("fn f() { let p = 8080; }", "rust"), parse("fn f() { let p = 3000; }", "rust")
    assert a.structural == b.structural and a.content != b.content and {o["op_type"] for o in diff(a, b)} == {"MODIFY"}
    a, b = parse("fn f() { x = 1; }", "rust"), parse("fn f() { x += 1; }", "rust")
    found = diff(a, b)
    assert a.content != b.content and found and all(o["is_logic_op"] for o in found)


def test_json_pairs_are_named_by_line():
    a, b = '{"v": "1"}', '{"v": "2"}'
    assert ops(a, b, "json") == [("MODIFY", "pair 'anon@L1' modified")]
    assert parse(a, "json").structural == parse(b, "json").structural


def test_windows_prune_large_files():
    root = parse("".join(f"fn func_{i}() {{}}\n" for i in range(2000)), "rust")
    names = [x.name for x in significant(root, [(9, 11)], 2 << 20)]
    assert "func_10" in names and len(names) <= 10
    assert len(significant(root, [(9, 11)], 100)) == 2000


def test_hundred_files_and_moves_between_files():
    old = {f"f{i:03}.rs": parse(f"fn f{i}() {{ {i}; }}", "rust") for i in range(100)}
    new = {f"f{i:03}.rs": parse(f"fn f{i}() {{ {i + 1}; }}", "rust") for i in range(100)}
    assert len(multi_file(old, new)) == 100
    got = multi_file({"a.rs": parse("fn g() { x(); }\nfn k() {}", "rust"), "b.rs": parse("fn z() {}", "rust")}, {"a.rs": parse("fn k() {}", "rust"), "b.rs": parse("fn z() {}\nfn g() { x(); }", "rust")})
    assert [o["op_type"] for o in got["a.rs"]] == ["MOVE"] and got["b.rs"] == [] and got["a.rs"][0]["details"].startswith("Moved to b.rs:L2")


def test_scores():
    a = parse("fn f(a: i32, b: i32) { g(a, b); }", "rust")
    b = parse("fn f(a: i32, b: i32) { g(b, a); }", "rust")
    s = score(a, b)
    assert s["similarity_percent"] < 100 and s["cyclomatic_delta"] == 0 and not s["control_flow_changed"] and s["change_intensity"] == "low"
    assert penalty(list("abc"), list("acb")) > 0 == penalty(list("ab"), list("abc")) and penalty([], []) == 0
    assert multiset([], []) == 1 and multiset(["a"], []) == 0 and 0 < multiset(["100"] * 3, ["100", "200", "300"]) < 1
    assert score(parse("fn f() { a(); }", "rust"), parse("fn f() { if a == 1 { b(); } }", "rust"))["control_flow_changed"]
    assert composite(a, a) == 1


def test_patterns():
    body = "let a = one(); let b = two(a); if a == b { three(b, 1); } for i in list { x.push(i + 1); } while go { step!(a); } match b { 1 => four(), _ => { five(\"s\") } } let c: Vec<u8> = vec![1]; c[0] = -a;"
    a, b = parse(f"fn whole() {{ {body} done() }}", "rust"), parse(f"fn whole() {{ part(); done() }}\nfn part() {{ {body} }}", "rust")
    assert any(p["kind"] == "extract_method" and p["confidence"] > 0.8 for p in facts.patterns(diff(a, b), a, b))
    a, b = parse("fn f() { g(1, 2); }\nfn k() {}", "rust"), parse("fn h() { g(1, 2); }\nfn k() {}", "rust")
    assert [p["involved_entities"] for p in facts.patterns(diff(a, b), a, b)] == [["f", "h"]]


def test_symbols_across_files():
    fn = "fn g(x: i32) -> i32 { let y = x + 1; y }"
    pairs = [("a.rs", parse(fn, "rust"), parse("", "rust")), ("b.rs", parse("", "rust"), parse(fn, "rust"))]
    found = facts.cross_file(pairs)
    assert [(e["event"], e["old_file"], e["new_file"]) for e in found if e["old_symbol"] == "g"] == [("cross_file_move", "a.rs", "b.rs")]
    pairs[1] = ("b.rs", parse("", "rust"), parse(fn.replace("g(", "h("), "rust"))
    assert "cross_file_rename" in [e["event"] for e in facts.cross_file(pairs)]
    pairs[1] = ("b.rs", parse("", "rust"), parse("fn g(x: i32) -> i32 { let y = x + 1; let z = y; y }", "rust"))
    assert "api_surface_change" in [e["event"] for e in facts.cross_file(pairs)]
    assert facts.cross_file([("a.rs", parse(fn, "rust"), parse(fn, "rust"))]) == []


def test_calls():
    defined, calls = facts.functions_and_calls(parse("fn a() { b(); x.c(); a(); }\nfn b() {}\nd();", "rust"))
    assert [d[0] for d in defined] == ["a", "b"] and ("a", "b", 0) in calls and ("a", "x", 0) in calls and not any(c[1] in ("a", "d") for c in calls)


def test_data_flow():
    a = parse("fn f() { let total = 1; total + 2 }", "rust")
    assert facts.data_flow(a, a)["tag"] == "UNCHANGED"
    assert facts.data_flow(a, parse("fn f() { let sum = 1; sum + 2 }", "rust"))["tag"] == "COSMETIC_LOCAL_RENAME"
    assert facts.data_flow(parse("fn f() { let t = 1; return t; }", "rust"), parse("fn f() { let t = 1; return u; }", "rust"))["tag"] == "DATA_FLOW_MUTATED"
    assert facts.data_flow(parse("fn f() { let t = 1; g(t); }", "rust"), parse("fn f() { let t = 1; while h() { g(t); } }", "rust"))["tag"] == "PURE_CONTROL_FLOW"


def test_guards():
    a = parse("fn f(p: P) { if p != null { guard.lock(); } if i < len { free(p); } x.close(); }", "rust")
    found = {(v["rule"], v["severity"]) for v in facts.violations("a.rs", a, parse("fn f(p: P) { }", "rust"))}
    assert {("REMOVED_NULL_CHECK", "CRITICAL"), ("STRIPPED_LOCK_GUARD", "CRITICAL"), ("OMITTED_RESOURCE_CLEANUP", "WARN"), ("REMOVED_BOUNDS_CHECK", "ERROR")} == found
    nulls = [v for v in facts.violations("a.rs", parse("fn f() { if x != null { y(); } }", "rust"), parse("fn f() {}", "rust"))]
    assert len(nulls) == 2  # the condition and what holds it
    assert facts.violations("a.rs", a, a) == []


def test_types():
    assert "Option to Result" in facts.type_refactor(parse("fn f() -> Option<i32> { g() }", "rust"), parse("fn f() -> Result<i32> { g() }", "rust"))
    assert "widening" in facts.type_refactor(parse("fn f(a: i32) {}", "rust"), parse("fn f(a: i64) {}", "rust"))
    assert facts.type_refactor(parse("fn f() {}", "rust"), parse("fn f() {}", "rust")) is None


def test_merge():
    base = "fn a() -> i32 { 1 }\n\nfn b() -> i32 { 2 }\n"
    ours, theirs = base.replace("{ 1 }", "{ one() }"), base.replace("{ 2 }", "{ two() }")
    assert merge(base, ours, theirs, "x.rs", "rust") == (ours.replace("{ 2 }", "{ two() }"), 0)
    assert merge(base, ours, ours, "x.rs", "rust") == (ours, 0) == merge(base, ours, base, "x.rs", "rust") and merge(base, base, theirs, "x.rs", "rust") == (theirs, 0)
    text, status = merge("a\n", "b", "c\n", "x.txt", None)
    assert status == 1 and text == "<<<<<<< Ours: x.txt\nb\n=======\nc\n>>>>>>> Theirs: x.txt\n"
    assert merge(base, base.replace("1", "3"), base.replace("1", "4"), "x.rs", "rust")[1] == 1


def test_edits_and_columns():
    assert edit("abc", "abc") == (3, 3, 3) and edit("abc", "axc") == (1, 2, 2) and edit("", "ab") == (0, 0, 2)
    assert point("a\nbé\nc", 5) == (1, 3) and char_column("é😀x", 6) == 2 and char_column("é😀x", 4) == 1
    assert overlaps(0, 5, [(4, 6)]) and not overlaps(0, 4, [(4, 6)])
    a, b = "fn a() { 1; }\nfn b() { 2; }", "fn a() { 1; }\nfn b() { 3; }"
    r = reused(parse(a, "rust"), parse(b, "rust"), edit(a, b))
    assert 0 < r["reused"] == r["outside"] < r["nodes"]


def test_limits():
    with pytest.raises(ParseLimit):
        parse("fn a() {}", "rust", limits=Limits(max_bytes=3))
    with pytest.raises(ParseLimit):
        parse("fn a() {}", "rust", limits=Limits(max_nodes=2))
    with pytest.raises(ParseLimit):
        parse("[" * 100 + "]" * 100, "json", limits=Limits(max_depth=50))
    with pytest.raises(ValueError):
        parse("x", "cobol")
    assert Limits().key() == Limits().key() != Limits(max_nodes=1).key()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.sampled_from(sorted(LANGUAGES)))
def test_any_text_parses(text, lang):
    root = parse(text, lang)
    assert diff(root, parse(text, lang)) == []
    assert facts.data_flow(root, root)["tag"] == "UNCHANGED" and facts.violations("x", root, root) == []


@settings(max_examples=50, deadline=None)
@given(st.from_regex("[a-z]{3,8}", fullmatch=True), st.from_regex("[a-z]{3,8}", fullmatch=True), st.integers(0, 999))
def test_rename_keeps_the_shape(a, b, n):
    x, y = (parse(f"fn w_{k}() {{ let v_{k} = {n}; }}", "rust") for k in (a, b))
    assert x.structural == y.structural and x.identity == y.identity and only_identifiers(x, y) == (a != b)
    z = parse(f"fn w_{a}() {{ let v_{a} = {n + 1}; }}", "rust")
    assert z.content != x.content and name_of(x.children[0]) == f"w_{a}"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9))
def test_penalty_is_bounded(tokens):
    other = tokens[:]
    random.Random(1).shuffle(other)
    assert 0 <= penalty(tokens, other) <= 0.2 and penalty(tokens, tokens) == 0 and multiset(tokens, other) == 1


def test_unclosed_elements_do_not_nest():
    from graftwork.parse.html_tree import parse_html

    page = "<body><ul>" + "<li>one<p>two" * 3000 + "</ul><table>" + "<tr><td>a<td>b" * 3000 + "</table><div><p>x<div>y</div></div>"
    root = parse_html(page)
    depth, stack, tags = 0, [(root, 0)], []
    while stack:
        n, d = stack.pop()
        depth = max(depth, d)
        tags += [n.text] if n.kind == "tag_name" else []
        stack += [(c, d + 1) for c in n.children]
    assert depth < 12 and tags.count("li") == 3000 and tags.count("td") == 6000


def test_a_parse_is_stopped(monkeypatch):
    import time

    import pytest

    from graftwork import parse

    monkeypatch.setattr(parse, "parse_json", lambda text: time.sleep(5))
    began = time.monotonic()
    with pytest.raises(parse.ParseLimit):
        parse.parse("{}", "json", limits=parse.Limits(timeout_ms=50))
    assert time.monotonic() - began < 2


def test_index_finds_by_all_keys():
    from graftwork.engine.diff import Index
    from graftwork.parse import parse

    a, b = parse("fn one(x: i32) -> i32 { x + 1 }", "rust"), parse("fn two(x: i32) -> i32 { x + 1 }", "rust")
    index = Index({"a.rs": a, "b.rs": b})
    f = a.children[0]
    assert index.find("name", (f.kind, "one"), "b.rs")[0] == "a.rs" and index.find("name", (f.kind, "one"), "a.rs") is None
    assert index.find("structure", f.structural, "a.rs")[0] == "b.rs" and index.find("identity", f.identity, "a.rs")[1].name == "two"


def test_settings(tmp_path, monkeypatch):
    from graftwork import cli

    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    (tmp_path / "home" / ".config" / "graftwork").mkdir(parents=True)
    (tmp_path / "home" / ".config" / "graftwork" / "graftwork.toml").write_text("[output]\nformat = 'md'\n")
    assert cli.config(str(tmp_path))["output"] == {"format": "md"}
    (tmp_path / "graftwork.toml").write_text("[default]\nlogic_only = true\nother = 1\n[limits]\nmax_nodes = 'many'\n")
    assert cli.config(str(tmp_path)) == {"default": {"logic_only": True}, "limits": {}, "output": {}}
    (tmp_path / ".graftwork.toml").write_text("not = = toml")
    assert cli.config(str(tmp_path))["default"] == {"logic_only": True}
