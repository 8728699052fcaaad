"""Comparisons as tables."""

import json
import subprocess

import snippets
from graftwork.operators import code, lint, report
from graftwork.sources import cache, git
from graftwork.sources.paths import glob_regex, language_of
from graftwork.streaming import compare_stream


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def test_a_commit_as_tables(spark):
    diffs = code.file_diffs(snippets.pairs(spark)).cache()
    assert {r["file_path"] for r in rows(diffs)} == {"src/check.rs", "app/load.py", "app/read.py", "web/area.js", "conf.json", "Main.java", "pad.c"}
    s = {r["commit"]: r for r in rows(code.summary(diffs))}
    assert s["c3"]["DELETE".lower()] == 2 and s["c4"]["files"] == 1 and s["c4"]["modify"] == 0
    v = {r["commit"]: r for r in rows(code.verdicts(diffs))}
    assert v["c4"]["primary_class"] == "formatting_only" and v["c4"]["confidence"] == 1.0 and v["c3"]["primary_class"] == "cleanup"
    assert {r["rule"] for r in rows(diffs.selectExpr("inline(violations)"))} == {"REMOVED_NULL_CHECK", "STRIPPED_LOCK_GUARD"}
    sarif = json.loads(next(r["sarif"] for r in rows(report.sarif(diffs)) if r["commit"] == "c3"))
    assert [r["ruleId"] for r in sarif["runs"][0]["results"]] == ["delete", "delete"]
    line = json.loads(next(r["json"] for r in rows(report.json_lines(diffs)) if r["file_path"] == "pad.c"))
    assert line == {"filePath": "pad.c", "operations": []}
    files = report.collect(diffs, "c1")
    more = report.about(snippets.pairs(spark), diffs, "c1")
    assert more["classification"] and more["flows"] and more["events"]
    more["radius"] = report.about(snippets.pairs(spark), diffs, "c2")["radius"]
    assert {r["total"] > 0 for r in more["radius"]} == {True, False}  # all reports of a commit with callers
    for form in report.FORMATS:
        assert report.render(files, form, "c1", more)
    text = report.render(files, "text", "c1", more)
    assert all(f"{h}:" in text for h in ("Class", "Across files", "Callers of what changed", "Data flow")) and "check.rs" in report.render(files, "html", "c1", more)
    assert "check.rs" in report.show(files) and report.failed_check(diffs)


def test_blast_radius(spark):
    files = [("c", "a.rs", "rust", "fn leaf() { 1; }"), ("c", "b.rs", "rust", "fn mid() { leaf(); }"), ("c", "d.rs", "rust", "fn top() { mid(); }\nfn ring() { top(); ring2(); }\nfn ring2() { ring(); }")]
    found = code.functions_and_calls(spark.createDataFrame(files, "commit STRING, file_path STRING, lang STRING, text STRING"))
    changed = spark.createDataFrame([("c", "leaf", "a.rs"), ("c", "leaf", "elsewhere.rs"), ("c", "ring", "d.rs"), ("c", "none", "a.rs")], "commit STRING, symbol STRING, file_path STRING")
    got = {(r["symbol"], r["file_path"]): r for r in rows(code.blast_radius(found, changed))}
    assert [(c["caller_symbol"], c["depth"]) for c in got["leaf", "a.rs"]["callers"]] == [("mid", 1), ("top", 2), ("ring", 3), ("ring2", 4)]
    assert got["leaf", "elsewhere.rs"]["total"] == 4 and got["ring", "d.rs"]["total"] == 1 and got["none", "a.rs"]["severity"] == "LOW"


def test_lint(spark):
    p = snippets.pairs(spark).where("commit = 'c2' and new_text is not null")
    n = code.nodes(p, "file_path", "new_text", p["lang"]).withColumnRenamed("id", "file_path")
    found = lint.lint_nodes(n, snippets.RULES)
    assert sorted((r["file_path"], r["row"], r["rule_name"]) for r in rows(found)) == [("web/area.js", 2, "no_open"), ("web/area.js", 2, "no_panic")]
    r = rows(lint.lint_result(found, 5))[0]
    assert (r["errors"], r["warnings"], r["passed"]) == (1, 1, False)
    assert lint.lint_nodes(n, []).count() == 0


def test_rule_files(spark, tmp_path):
    (tmp_path / "no_x.scm").write_text(";; @severity error now\n;; @message in $file\n(identifier)")
    (tmp_path / "plain.scm").write_text("(x)")
    a, b = lint.load_rules(spark, str(tmp_path))
    assert (a.name, a.severity, a.message) == ("no_x", "ERROR", "in $file") and (b.severity, b.message) == ("WARN", "Rule 'plain' violation detected")


def test_limits_are_errors(spark):
    from graftwork.parse import Limits

    p = spark.createDataFrame([("c", "a.json", "json", "[1]", "[1, 2, 3, 4, 5, 6]")], "commit STRING, file_path STRING, lang STRING, old_text STRING, new_text STRING")
    r = rows(code.file_diffs(p, limits=Limits(max_nodes=4)))[0]
    assert "nodes" in r["error"] and r["operations"] == []


def test_git_source(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tmp_path), *a], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.rs").write_text("fn a() { 1; }\n")
    (tmp_path / "gone.py").write_text("x = 1\n")
    (tmp_path / "note.txt").write_text("x")
    run("add", "."), run("commit", "-qm", "1")
    (tmp_path / "a.rs").write_text("fn a() { 2; }\n")
    (tmp_path / "gone.py").unlink()
    run("add", "-A"), run("commit", "-qm", "2")
    got = {r["file_path"]: r for r in rows(git.changed_files(spark, str(tmp_path)))}
    assert got["a.rs"]["old_text"] == "fn a() { 1; }\n" and got["a.rs"]["new_text"] == "fn a() { 2; }\n" and got["gone.py"]["new_text"] is None and got["gone.py"]["status"] == "Deleted" and "note.txt" not in got
    (tmp_path / "a.rs").write_text("fn a() { 3; }\n")
    assert [r["new_text"] for r in rows(git.changed_files(spark, str(tmp_path), "HEAD", None))] == ["fn a() { 3; }\n"]
    run("add", "-A")
    assert [r["new_text"] for r in rows(git.changed_files(spark, str(tmp_path), "HEAD", None, staged=True))] == ["fn a() { 3; }\n"]
    assert rows(git.changed_files(spark, str(tmp_path), path="*.py"))[0]["file_path"] == "gone.py"
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "b.rs").write_text("fn b() {}")
    assert [r["file_path"].rsplit("/", 1)[1] for r in rows(git.source_files(spark, str(tmp_path)))] == ["a.rs"]


def test_cache(spark, tmp_path):
    p = cache.diff_key(snippets.pairs(spark).where("commit = 'c2' and old_text <> new_text"), False, "k")
    calls = []

    def compute(missing):
        calls.append(missing.count())
        keys = missing.select("commit", "file_path", "cache_key")
        return code.file_diffs(missing).join(keys, ["commit", "file_path"])

    path = f"file://{tmp_path}/cache"
    first = cache.through(p, path, compute).count()
    assert cache.through(p, path, compute).count() == first and calls == [2, 0]
    assert rows(cache.stats(spark, path))[0]["entries"] == first and cache.safe_key("ab12") and not cache.safe_key("../x")


def test_stream(spark, tmp_path):
    snippets.pairs(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(snippets.pairs(spark).schema).parquet(f"{tmp_path}/in")
    compare_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == code.operations(code.file_diffs(snippets.pairs(spark))).count()


def test_paths():
    import re

    assert language_of("a/b.PY") is None and language_of("x.h++") == "cpp" and language_of(".rs") is None
    for pattern, yes, no in (("src/**/*.rs", "src/a/b.rs", "lib/a.rs"), ("**/*.{js,ts}", "a/b.ts", "a/b.rs"), ("*.py", "a.py", "b/a.py"), ("a[!b]c?", "axcd", "abcd")):
        assert re.match(glob_regex(pattern), yes) and not re.match(glob_regex(pattern), no)
    assert re.match(glob_regex("src/**/*.rs"), "src/b.rs")


def test_windows_reuse_and_symbols(spark):
    big = "".join(f"fn func_{i}(x: i32) -> i32 {{\n    x + {i}\n}}\n" for i in range(2000)) + "// " + "x" * (1 << 20) + "\n"
    changed = big.replace("x + 10\n", "x + 11111\n").replace("x + 1500\n", "x + 22222\n")
    df = spark.createDataFrame([("c", "a.rs", "rust", big, changed)], "commit STRING, file_path STRING, lang STRING, old_text STRING, new_text STRING")
    whole = [r["details"] for r in rows(code.operations(code.file_diffs(df)))]
    some = [r["details"] for r in rows(code.operations(code.file_diffs(df.selectExpr("*", "array(named_struct('lo', 29, 'hi', 33)) AS windows"))))]
    assert any("func_1500" in d for d in whole) and any("func_10'" in d for d in some) and not any("func_1500" in d for d in some)
    r = rows(code.reuse(df))[0]
    assert 0 < r["reused"] <= r["outside"] < r["nodes"]
    assert rows(code.symbol_counts(df))[0]["symbols"] == 4000


def test_results_are_kept(spark, tmp_path, monkeypatch):
    p = snippets.pairs(spark)
    key = lambda df: sorted((r["commit"], r["file_path"], str(r["operations"])) for r in rows(df))
    want = key(code.file_diffs(p))
    assert key(cache.diffs(p, f"{tmp_path}/diffs")) == want
    entries = cache.stats(spark, f"{tmp_path}/diffs").first().entries
    assert key(cache.diffs(p, f"{tmp_path}/diffs")) == want and cache.stats(spark, f"{tmp_path}/diffs").first().entries == entries
    files = p.where("new_text is not null").selectExpr("file_path", "lang", "new_text AS text").unionByName(p.where("file_path = 'conf.json'").selectExpr("'copy.json' AS file_path", "lang", "new_text AS text"))
    whole = sorted(map(str, code.nodes(files, "file_path", "text", files["lang"]).collect()))
    for _ in range(2):
        assert sorted(map(str, cache.trees(files, f"{tmp_path}/trees").select(*[f.split()[0] for f in code._fields(code.NODES)]).collect())) == whole
