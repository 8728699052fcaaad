"""Command line: compare commits, lint a folder, merge three files, compare two."""

from __future__ import annotations

import argparse
import sys
import tomllib
from pathlib import Path

FOUND = (".graftwork.toml", "graftwork.toml")
#: Sections and settings of a file of settings.
SETTINGS = {"default": {"logic_only": bool, "json": bool}, "limits": {"max_bytes": int, "max_nodes": int, "max_depth": int, "timeout_ms": int}, "output": {"format": str}}


def config(repo: str, given: str | None = None) -> dict:
    """Settings of the given file, else the first that can be read in the repository or the home folder, else none; unknown ones are left out."""
    for path in [*([Path(given)] if given else []), *(Path(d) / f for d in (repo, Path.home()) for f in FOUND), Path.home() / ".config" / "graftwork" / "graftwork.toml"]:
        if path.is_file():
            try:
                read = tomllib.loads(path.read_text())
            except tomllib.TOMLDecodeError:
                continue
            return {s: {k: v for k, v in read.get(s, {}).items() if isinstance(v, SETTINGS[s].get(k, ()))} for s in SETTINGS}
    return {}


def targets(args: list[str]) -> tuple[str, str, str | None]:
    """Repository and the two commits: by default the last commit against the one before it; of one commit, against the files on disk."""
    repo = args.pop(0) if args and Path(args[0]).is_dir() else "."
    if not args:
        return repo, "HEAD~1", "HEAD"
    return repo, args[0], args[1] if len(args) > 1 else None


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graftwork")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("diff")
    d.add_argument("target", nargs="*")
    d.add_argument("--path")
    d.add_argument("--format", default=None)
    d.add_argument("--config")
    d.add_argument("--cache", help="folder of results that are kept by content")
    for flag in ("--staged", "--logic-only", "--check", "--compact", "--full"):
        d.add_argument(flag, action="store_true")
    li = sub.add_parser("lint")
    li.add_argument("path", nargs="?", default=".")
    li.add_argument("--rules", required=True)
    li.add_argument("--max-warnings", type=int, default=0)
    li.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    m = sub.add_parser("merge-driver")
    m.add_argument("versions", nargs=3)
    m.add_argument("path")
    two = sub.add_parser("files")
    two.add_argument("old")
    two.add_argument("new")
    a = p.parse_args(argv)
    if a.command == "merge-driver":
        from graftwork.engine.merge import merge
        from graftwork.sources.paths import language_of

        texts = [Path(f).read_text() if Path(f).is_file() else "" for f in a.versions]
        text, status = merge(*texts, a.path, language_of(a.path))
        Path(a.versions[1]).write_text(text)
        return status

    from pyspark.sql import SparkSession

    from graftwork.operators import code, lint, report
    from graftwork.parse import Limits
    from graftwork.sources import cache, git

    spark = SparkSession.builder.getOrCreate()
    if a.command == "lint":
        files = git.source_files(spark, a.path)
        nodes = code.nodes(files, "file_path", "text", files["lang"]).withColumnRenamed("id", "file_path")
        found = lint.lint_nodes(nodes, lint.load_rules(spark, a.rules))
        result = lint.lint_result(found, a.max_warnings).first().asDict()
        print(report.render_lint([r.asDict() for r in found.orderBy("file_path", "row", "rule_name").collect()], result, a.format))
        return int(not result["passed"])
    if a.command == "files":
        pairs, name, settings = git.two_files(spark, a.new, a.old, a.new), "", {}
        compact, full, form, check, logic = False, False, None, False, False
    else:
        repo, old, new = targets(a.target)
        settings = config(repo, a.config)
        pairs = git.changed_files(spark, repo, old, new, a.staged, a.path)
        name = f"{old}..{'index' if a.staged else new or 'worktree'}"
        default = settings.get("default", {})
        form = a.format or ("json" if default.get("json") else settings.get("output", {}).get("format"))
        compact, full, check, logic = a.compact, a.full, a.check, a.logic_only or default.get("logic_only", False)
    limits = Limits(**settings.get("limits", {}))
    kept = getattr(a, "cache", None)
    diffs = (cache.diffs(pairs, kept, logic, limits) if kept else code.file_diffs(pairs, logic, limits)).persist()
    files = report.collect(diffs, name)
    more = report.about(pairs, diffs, name, logic, limits)
    print(report.render(files, form, name, more) if form else report.show(files, compact, full, more))
    return int(check and report.failed_check(diffs))


if __name__ == "__main__":
    sys.exit(main())
