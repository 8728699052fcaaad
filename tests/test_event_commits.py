"""Queries of commits read the whole table of events."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graftwork.engine.merge import merge
from graftwork.plans import sources

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def changes(spark):
    """(commit, file, old, new) of each event whose properties differ from the ones before."""
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("month", F.date_format("ts", "yyyy-MM")).orderBy("event_id").collect()
    last, out = {}, []
    for e in events:
        old = last.get((e.user_id, e.event_type))
        if old != e.props:
            out.append((f"{e.user_id} {e.month}", f"{e.event_type}/{e.event_id}", old, e.props))
        last[e.user_id, e.event_type] = e.props
    return out


def test_every_changed_event_is_a_file(spark, changes):
    files = defaultdict(int)
    for c, *_ in changes:
        files[c] += 1
    s = {r["commit"]: r for r in sources.commit_summary(spark, SF).collect()}
    assert {c: r.files for c, r in s.items()} == dict(files)
    want = sorted((c, f, "INSERT" if old is None else "MODIFY") for c, f, old, _ in changes)
    assert sorted((r["commit"], r.file_path, r.op_type) for r in sources.commit_operations(spark, SF).collect()) == want
    assert {r["commit"]: r.files for r in sources.commit_classes(spark, SF).collect()} == dict(files)
    assert {f for _, f, *_ in changes} == {json.loads(r.json)["filePath"] for r in sources.json_report(spark, SF).collect()}
    results = [x for r in sources.sarif_report(spark, SF).collect() for x in json.loads(r.sarif)["runs"][0]["results"]]
    assert len(results) == len(changes)
    assert {r["commit"] for r in sources.commit_multifile(spark, SF).collect()} == set(files)


def test_every_event_is_linted_and_merged(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect()
    found = {r.file_path for r in sources.commit_lint(spark, SF).where("rule_name = 'no_k'").collect()}
    assert found == {f"{e.event_type}/{e.event_id}" for e in events if '"k"' in e.props}
    runs = defaultdict(list)
    for e in events:
        runs[e.user_id, e.event_type].append(e)
    want = set()
    for run in runs.values():
        for before, e, after in zip([None, *run], run, [*run[1:], None]):
            path = f"{e.event_type}/{e.event_id}"
            want.add((path, *merge(e.props, before.props if before else "", after.props if after else "", path, "json")))
    assert {(r.path, r.merged, r.status) for r in sources.commit_merge(spark, SF).collect()} == want
