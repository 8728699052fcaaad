"""Queries of trees and comparisons: over the driver's JSON and HTML columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftwork.operators import code, lint, report
from graftwork.parse import Limits
from graftwork.storage import table

#: For properties of events; rules go by words.
EVENT_RULES = [lint.Rule("no_null", "ERROR", "null in $file at $line", "(null) @n"), lint.Rule("no_k", "WARN", "key k in $file at $line", "(string_content) @k")]


def _event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties as a version of the ones before, of the same user and kind."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", *_versions())
    return e.select(F.col("event_type").alias("commit"), F.col("event_id").cast("string").alias("file_path"), F.lit("json").alias("lang"), "old_text", "new_text")


def _event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of events, with what a user did in a month as a commit, so that no commit grows with the table; null users or times are commits of their own."""
    of = F.concat_ws(" ", F.coalesce(F.col("user_id").cast("string"), F.lit("?")), F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit("?")))
    e = table(spark, sf_dir, "events").select("event_id", "event_type", of.alias("commit"), *_versions())
    return e.select("commit", F.concat_ws("/", F.coalesce("event_type", F.lit("?")), F.col("event_id").cast("string")).alias("file_path"), F.lit("json").alias("lang"), "old_text", "new_text")


def _versions() -> list[Column]:
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return [F.lag("props").over(w).alias("old_text"), F.col("props").alias("new_text")]


def _event_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's properties as base, the ones before and after it, of the same user and kind, as the versions to merge; at an end the version is missing."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("/", F.coalesce("event_type", F.lit("?")), F.col("event_id").cast("string")).alias("path"), F.lit("json").alias("lang"), F.col("props").alias("base"), F.lag("props").over(w).alias("ours"), F.lead("props").over(w).alias("theirs"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_version_diff(spark, sf_dir)


def json_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = code.operations(code.file_diffs(_event_pairs(spark, sf_dir)))
    return ops.groupBy(F.col("commit").alias("event_type"), "op_type", "entity_type").agg(F.count("*").alias("n"))


def json_props_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = code.nodes(table(spark, sf_dir, "events"), "event_id", "props", "json")
    return n.select(F.col("id").cast("long").alias("event_id"), "node_id", "parent_id", "kind", "text", "subtree_size")


def html_dom_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages are no code: no limit, so that none of them is left out
    n = code.nodes(table(spark, sf_dir, "pages"), "page_id", "html", "html", limits=Limits(1 << 40, 1 << 40, 1 << 40, 1 << 40))
    return n.where("kind = 'tag_name' OR error IS NOT NULL").groupBy(F.col("id").cast("long").alias("page_id"), F.coalesce("text", "error").alias("tag")).agg(F.count("*").alias("n"))


def commit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.summary(code.file_diffs(_event_commits(spark, sf_dir)))


def commit_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.operations(code.file_diffs(_event_commits(spark, sf_dir))).select("commit", "file_path", "seq", "op_type", "entity_type", "old_location", "new_location", "details", F.round("similarity.similarity_percent", 3).alias("similarity"), "is_logic_op")


def commit_multifile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.operations(code.by_commit(_event_commits(spark, sf_dir), events=False)).select("commit", "file_path", "seq", "op_type", "details", "new_location")


def commit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.verdicts(code.file_diffs(_event_commits(spark, sf_dir))).select("commit", "files", "primary_class", "confidence", "intent_labels")


def commit_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _event_commits(spark, sf_dir).where("new_text is not null")
    n = code.nodes(p, "file_path", "new_text", p["lang"]).withColumnRenamed("id", "file_path")
    return lint.lint_nodes(n, EVENT_RULES)


def commit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.merged(_event_triples(spark, sf_dir))


def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif(code.file_diffs(_event_commits(spark, sf_dir)))


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_lines(code.file_diffs(_event_commits(spark, sf_dir)))


QUERIES = (
    json_version_diff, json_props_ast, html_dom_ast, commit_summary, commit_operations, commit_multifile, commit_classes, commit_lint, commit_merge, sarif_report, json_report,
)

_CHANGED = """WITH e AS (SELECT concat_ws(' ', coalesce(user_id::VARCHAR, '?'), coalesce(strftime(ts, '%Y-%m'), '?')) AS commit, concat_ws('/', coalesce(event_type, '?'), event_id::VARCHAR) AS file_path,
            props, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS old FROM events),
        c AS (SELECT *, old IS NULL AS fresh FROM e WHERE old IS NULL OR old <> props)"""
_DETAILS = "'pair ''anon@L1'' ' || CASE WHEN fresh THEN 'inserted' ELSE 'modified' END"
SQL = {
    "commit_summary": _CHANGED + """
        SELECT commit, count(*) AS files, 0::BIGINT AS move, 0::BIGINT AS rename, count(*) FILTER (fresh) AS insert, 0::BIGINT AS delete, count(*) FILTER (NOT fresh) AS modify FROM c GROUP BY commit""",
    "commit_operations": f"""{_CHANGED}
        SELECT commit, file_path, 0 AS seq, CASE WHEN fresh THEN 'INSERT' ELSE 'MODIFY' END AS op_type, 'variable' AS entity_type, CASE WHEN NOT fresh THEN 'L1' END AS old_location, 'L1' AS new_location,
            {_DETAILS} AS details, CASE WHEN NOT fresh THEN 80.0::DOUBLE END AS similarity, true AS is_logic_op FROM c""",
    "commit_multifile": f"""{_CHANGED}
        SELECT commit, file_path, 0 AS seq, CASE WHEN fresh THEN 'INSERT' ELSE 'MODIFY' END AS op_type, {_DETAILS} AS details, 'L1' AS new_location FROM c""",
    "commit_lint": """SELECT concat_ws('/', coalesce(event_type, '?'), event_id::VARCHAR) AS file_path, 0 AS row, 'no_k' AS rule_name, 'WARN' AS severity,
        'key k in ' || concat_ws('/', coalesce(event_type, '?'), event_id::VARCHAR) || ' at 0' AS message FROM events WHERE props LIKE '%"k"%'""",
    "json_report": f"""{_CHANGED}
        SELECT commit, file_path, '{{"filePath":"' || file_path || '","operations":[{{"type":"' || CASE WHEN fresh THEN 'INSERT' ELSE 'MODIFY' END || '","entityType":"variable",' || CASE WHEN fresh THEN '' ELSE '"oldLocation":"L1",' END
            || '"newLocation":"L1","details":"' || {_DETAILS} || '",' || CASE WHEN fresh THEN '' ELSE '"similarity":{{"structure_similarity":1.0,"token_similarity":0.3333333333333333,"node_count_delta":0,"cyclomatic_delta":0,"control_flow_changed":false,"similarity_percent":80.0,"change_intensity":"low"}},' END
            || '"isLogicOp":true}}]}}' AS json FROM c""",
    "json_version_diff": """WITH e AS (SELECT event_id, event_type, props, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS old FROM events)
        SELECT event_type, CASE WHEN old IS NULL THEN 'INSERT' ELSE 'MODIFY' END AS op_type, 'variable' AS entity_type, count(*) AS n FROM e WHERE old IS NULL OR old <> props GROUP BY ALL""",
    "json_props_ast": """WITH e AS (SELECT event_id, json_keys(props::JSON)[1] AS k, props FROM events), v AS (SELECT event_id, k, json_extract_string(props, '$.' || k) AS v FROM e),
        n AS (SELECT event_id, unnest([{'i': 0, 'p': -1, 'kind': 'document', 't': '', 's': 6}, {'i': 1, 'p': 0, 'kind': 'object', 't': '', 's': 5}, {'i': 2, 'p': 1, 'kind': 'pair', 't': '', 's': 4},
            {'i': 3, 'p': 2, 'kind': 'string', 't': '', 's': 2}, {'i': 4, 'p': 3, 'kind': 'string_content', 't': k, 's': 1}, {'i': 5, 'p': 2, 'kind': 'number', 't': v, 's': 1}]) AS x FROM v)
        SELECT event_id, x.i::BIGINT AS node_id, x.p::BIGINT AS parent_id, x.kind AS kind, x.t AS text, x.s::BIGINT AS subtree_size FROM n""",
    "html_dom_ast": """WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages)
        SELECT page_id, lower(tag) AS tag, count(*) AS n FROM t GROUP BY ALL""",
}
