"""Rules: loaded from files, matched against lines or nodes, and put before the details of operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORBIDDEN = ("eval", "exec", "panic", "unsafe", "unwrap")
RISKY = ("auth", "crypto", "verify")


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str = "WARN"
    message: str = ""
    source: str = ""


#: Rules for prose, for want of others.
RULES = (
    Rule("no_password", "ERROR", "secret in $file at $line", "(string) @s"),
    Rule("license_line", "INFO", "license in $file at $line", "(comment) @c"),
    Rule("contact_mail", "WARN", "address in $file at $line", "(string) @m"),
)


def parse_rule(stem: str, content: str) -> Rule:
    """A rule file: headers `;; @severity` and `;; @message` count, the last of each; all else is its source."""
    severity, message = "WARN", f"Rule '{stem}' violation detected"
    for line in map(str.strip, content.splitlines()):
        if line.startswith(";; @severity"):
            word = line[12:].upper()
            severity = "ERROR" if "ERROR" in word else "INFO" if "INFO" in word else "WARN"
        elif line.startswith(";; @message"):
            message = line[11:].strip()
    return Rule(stem, severity, message, content)


def load_rules(spark: SparkSession, folder: str) -> list[Rule]:
    """Rules of all .scm files of a folder, by name. A rule set is configuration, so it comes to the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.scm").load(folder).select("path", "content").collect()
    return sorted((parse_rule(f.path.rsplit("/", 1)[-1].removesuffix(".scm"), bytes(f.content).decode("utf-8", "replace")) for f in files), key=lambda r: r.name)


def _terms(rule: Rule) -> list[str]:
    return [t for t in rule.name.replace("_", " ").lower().split() if t != "no"]


def _holds(text: Column, rule: Rule) -> Column:
    out = F.lit(False)
    for t in _terms(rule):
        out = out | text.contains(t)
    return out


def lint_lines(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every line against every rule: (id, row, rule_name, severity, message), rows from 0. Each line is read once for all rules."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("row", "line")).withColumn("low", F.lower("line"))
    hits = F.array(*[F.when(_holds(F.col("low"), r), F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules])
    found = lines.select(id_col, F.col("row").cast("long").alias("row"), F.explode(hits).alias("x")).where("x is not null")
    return found.select(id_col, "row", "x.rule_name", "x.severity", F.replace(F.replace(F.col("x.message"), F.lit("$file"), F.col(id_col).cast("string")), F.lit("$line"), F.col("row").cast("string")).alias("message"))


def lint_nodes(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """Nodes (file_path, kind, text, start_row) against rules; one finding for each file, rule and row."""
    low, kind = F.lower(F.coalesce("text", F.lit(""))), F.lower("kind")
    forbidden = low.isin(*FORBIDDEN) | low.contains("raw_sql")
    hits = []
    for r in rules:
        term = (low != "") & _holds(low, r)
        hits.append(F.when(term | (forbidden & F.lit(r.source.lower()).contains(kind)), F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))))
    if not hits:
        return nodes.where("false").select("file_path", F.col("start_row").alias("row"), F.lit("").alias("rule_name"), F.lit("").alias("severity"), F.lit("").alias("message"))
    found = nodes.select("file_path", F.col("start_row").alias("row"), F.explode(F.array(*hits)).alias("x")).where("x is not null").dropDuplicates(["file_path", "row", "x"])
    return found.select("file_path", "row", "x.rule_name", "x.severity", F.replace(F.replace(F.col("x.message"), F.lit("$file"), F.col("file_path")), F.lit("$line"), F.col("row").cast("string")).alias("message"))


def lint_result(findings: DataFrame, max_warnings: int = 0) -> DataFrame:
    """One row: errors, warnings, infos, and whether they pass: no error and at most so many warnings."""
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(c) for s, c in (("ERROR", "errors"), ("WARN", "warnings"), ("INFO", "infos"))])
    return n.withColumn("passed", (F.col("errors") == 0) & (F.col("warnings") <= max_warnings))


def annotate(details: Column, rules: tuple[Rule, ...] | list[Rule] = RULES) -> Column:
    """Details with the mark of each rule that they concern before them, rule after rule."""
    for r in rules:
        mark = f"[{r.severity}] [{r.name}]"
        concern = F.lower(details).contains(r.name.lower()) | F.lit(r.source.lower()).contains(F.lower(details))
        for word in RISKY:
            concern = concern | details.contains(word)
        details = F.when(~details.startswith(mark) & concern, F.concat(F.lit(mark + " "), details)).otherwise(details)
    return details
