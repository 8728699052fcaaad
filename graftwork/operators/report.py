"""Reports of comparisons: rows of JSON and SARIF on the executors, text forms of single commits on the driver."""

from __future__ import annotations

import hashlib
import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.operators import code
from graftwork.parse import Limits

FORMATS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "stat": "stat", "name-only": "names", "names": "names", "prompt": "prompt", "llm": "prompt", "md": "markdown", "markdown": "markdown", "html": "html", "sarif": "sarif", "text": "text", "cli": "text", "micro": "micro"}


def _operation(o):
    s = o["similarity"]
    return F.struct(o["op_type"].alias("type"), o["entity_type"].alias("entityType"), o["old_location"].alias("oldLocation"), o["new_location"].alias("newLocation"), o["details"].alias("details"), s.alias("similarity"), o["is_logic_op"].alias("isLogicOp"))


def json_lines(diffs: DataFrame) -> DataFrame:
    """A JSON object for each file; absent values and empty lists of patterns are left out."""
    patterns = F.when(F.size("patterns") > 0, F.col("patterns"))
    return diffs.select("commit", "file_path", F.to_json(F.struct(F.col("file_path").alias("filePath"), F.transform("operations", _operation).alias("operations"), patterns.alias("refactorPatterns"))).alias("json"))


def sarif(diffs: DataFrame) -> DataFrame:
    """A SARIF 2.1.0 document for each commit, a result for each operation, in order of file and operation."""
    ops = diffs.select("commit", "file_path", F.posexplode("operations").alias("seq", "op"))
    result = F.struct(
        F.lower("op.op_type").alias("ruleId"), F.lit("note").alias("level"), F.struct(F.col("op.details").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
    )
    rows = ops.groupBy("commit").agg(F.array_sort(F.collect_list(F.struct("file_path", "seq", result.alias("r")))).alias("rows"))
    driver = F.struct(F.lit("graftwork").alias("name"), F.lit("0.1.0").alias("version"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("rows", lambda x: x["r"]).alias("results"))
    return rows.select("commit", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def lint_sarif(findings: DataFrame) -> DataFrame:
    """A SARIF document for each file with findings."""
    level = F.when(F.col("severity") == "ERROR", "error").when(F.col("severity") == "WARN", "warning").otherwise("note")
    result = F.struct(F.col("rule_name").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("row").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    rows = findings.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("row", "rule_name", result.alias("r")))).alias("rows"))
    run = F.struct(F.struct(F.struct(F.lit("graftwork").alias("name")).alias("driver")).alias("tool"), F.transform("rows", lambda x: x["r"]).alias("results"))
    return rows.select("file_path", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def collect(diffs: DataFrame, commit: str) -> list[dict]:
    """The files of one commit as plain values, by path: for the text forms below, which are for people."""
    return [r.asDict(True) for r in diffs.where(F.col("commit") == commit).orderBy("file_path").collect()]


def about(pairs: DataFrame, diffs: DataFrame, commit: str, logic_only: bool = False, limits: Limits | None = None) -> dict:
    """What is known of one commit as a whole, as plain values: its class, events across files, callers of what changed, and flows of functions."""
    own, files = pairs.where(F.col("commit") == commit), diffs.where(F.col("commit") == commit)
    plain = lambda df: [{k: v for k, v in r.asDict(True).items() if k != "commit"} for r in df.collect()]
    found = code.functions_and_calls(own.withColumn("text", F.col("new_text")), limits)
    radius = code.reported(code.blast_radius(found, code.changed_symbols(code.operations(files))))
    return {
        "classification": (plain(code.verdicts(files).select("commit", "primary_class", "confidence", "intent_labels")) or [None])[0],
        "events": plain(code.by_commit(own, True, logic_only, limits).orderBy("old_file", "old_symbol", "new_file")),
        "radius": plain(radius.orderBy("file_path", "symbol")),
        "flows": plain(code.function_flows(own, limits).where("tag <> 'UNCHANGED' OR type_refactor IS NOT NULL").orderBy("file_path", "name")),
    }


def _sections(more: dict) -> list[tuple[str, list[str]]]:
    """Headings and lines of about()."""
    c = more.get("classification")
    return [
        ("Class", [f"{c['primary_class']} ({c['confidence']:.0%})" + (f": {', '.join(c['intent_labels'])}" if c["intent_labels"] else "")] if c else []),
        ("Across files", [f"{e['event']}: {e['description']} ({e['similarity_score']:.2f})" for e in more.get("events", [])]),
        ("Callers of what changed", [f"{r['symbol']} in {r['file_path']}: {r['total']} callers, {r['severity']}" + "".join(f"; {x['caller_symbol']} in {x['caller_file']} at {x['depth']}" for x in r["callers"] or []) for r in more.get("radius", [])]),
        ("Data flow", [f"{f['name']} in {f['file_path']}: {f['tag']}" + (f", {f['type_refactor']}" if f["type_refactor"] else "") for f in more.get("flows", [])]),
    ]


def render(files: list[dict], form: str, title: str = "", more: dict | None = None) -> str:
    """more: what about() gives; its sections follow in the forms that have any."""
    form, more = FORMATS[form], more or {}
    sections = [(h, lines) for h, lines in _sections(more) if lines]
    below = [x for h, lines in sections for x in (f"{h}:", *(f"  {y}" for y in lines))]
    ops = [(f["file_path"], o) for f in files for o in f["operations"]]
    count = {k: sum(o["op_type"] == k for _, o in ops) for k in ("MOVE", "RENAME", "INSERT", "DELETE", "MODIFY")}
    line = lambda o: f"{o['op_type']:<7} {o['details']}  {o['old_location'] or '-'} -> {o['new_location'] or '-'}" + (f"  {o['similarity']['similarity_percent']:.1f}%" if o.get("similarity") else "")
    total = f"{len(files)} files, " + ", ".join(f"{n} {k.lower()}" for k, n in count.items())
    if form == "json":
        return json.dumps({"title": title, "summary": {"totalFiles": len(files)} | {k.lower(): n for k, n in count.items()}, "files": files} | {k: v for k, v in more.items() if v}, indent=2)
    if form == "jsonl":
        return "\n".join(json.dumps(f) for f in files)
    if form == "names":
        return "\n".join(f["file_path"] for f in files if f["operations"])
    if form == "stat":
        width = max([len(f["file_path"]) for f in files] or [0])
        return "\n".join([*(f"{f['file_path']:<{width}} | {len(f['operations']):>4} " + "".join(o["op_type"][0] for o in f["operations"]) for f in files), total])
    if form == "micro":
        return "\n".join(f"{p}: {line(o)}" for p, o in ops)
    if form == "sarif":
        results = [{"ruleId": o["op_type"].lower(), "level": "note", "message": {"text": o["details"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": p}}}]} for p, o in ops]
        return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "graftwork"}}, "results": results}]})
    if form == "prompt":
        return "\n".join([f"# Changes {title}".rstrip(), total, *(f"- {p}: {o['op_type'].lower()} {o['details']}" for p, o in ops), *(f"! {v['severity']} {v['rule']}: {v['message']}" for f in files for v in f["violations"]), *below])
    if form == "markdown":
        rows = [f"| {p} | {o['op_type']} | {o['entity_type']} | {o['details'].replace('|', chr(92) + '|')} |" for p, o in ops]
        return "\n".join([f"## {title or 'Changes'}", "", total, "", "| file | operation | entity | details |", "| --- | --- | --- | --- |", *rows, *(x for h, lines in sections for x in ("", f"### {h}", "", *(f"- {y}" for y in lines)))])
    if form == "html":
        mark = hashlib.sha256(json.dumps([files, more], sort_keys=True).encode()).hexdigest()
        rest = "".join(f"<h2>{html.escape(h)}</h2><ul>{''.join(f'<li>{html.escape(y)}</li>' for y in lines)}</ul>" for h, lines in sections)
        rows = "".join(f"<tr><td>{html.escape(p)}</td><td>{o['op_type']}</td><td>{html.escape(o['details'])}</td></tr>" for p, o in ops)
        return f"<!DOCTYPE html><title>{html.escape(title)}</title><p>{total}</p><table>{rows}</table>{rest}<p>sha256 {mark}</p>"
    out = [title, total] if title else [total]
    for f in files:
        if f["operations"] or f["patterns"] or f["violations"]:
            out += [f["file_path"], *(f"  {line(o)}" for o in f["operations"]), *(f"  ~ {p['description']}" for p in f["patterns"]), *(f"  ! {v['severity']} {v['message']}" for v in f["violations"])]
    return "\n".join([*out, *below])


def show(files: list[dict], compact: bool = False, full: bool = False, more: dict | None = None) -> str:
    """The short form for small changes, the long one for others or if asked."""
    ops = [o for f in files for o in f["operations"]]
    large = bool(more and more.get("events")) or any(f["patterns"] for f in files) or any(o["op_type"] == "MOVE" or "api surface" in o["details"].lower() for o in ops) or sum(bool(f["operations"]) for f in files) > 2 or len(ops) > 3
    return render(files, "micro" if compact or not full and not large else "text", more=more)


def failed_check(diffs: DataFrame) -> bool:
    """Whether any file has an operation."""
    return not diffs.where("size(operations) > 0").isEmpty()


def render_lint(findings: list[dict], result: dict, form: str) -> str:
    """Findings of the linter as text, JSON or SARIF."""
    if form == "json":
        return json.dumps({"findings": findings} | result, indent=2)
    if form == "sarif":
        level = {"ERROR": "error", "WARN": "warning"}
        results = [{"ruleId": f["rule_name"], "level": level.get(f["severity"], "note"), "message": {"text": f["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["file_path"]}, "region": {"startLine": f["row"]}}}]} for f in findings]
        return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "graftwork"}}, "results": results}]})
    return "\n".join([*(f"{f['file_path']}:{f['row']}: {f['severity']} [{f['rule_name']}] {f['message']}" for f in findings), f"{result['errors']} errors, {result['warnings']} warnings"])
