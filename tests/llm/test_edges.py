"""Odd rows and empty tables: what each operator's docstring says of them."""

import pytest
from pyspark.sql import functions as F

from graftwork.llm import decontaminate, embeddup, langid, lm, mixing, neardup, secrets, tokens, toxicity, warc


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_toxicity(odd, none, labels):
    got = toxicity.detect(odd, labels, all_rows=True).collect()
    assert len(got) == odd.count()
    blank = [r for r in got if r.doc_id in (900_001, 900_002, 900_003, 900_009)]
    assert len(blank) == 4 and not any(r.toxic for r in blank)
    same = {r.toxicity for r in got if r.doc_id in (900_005, 900_006, 900_007)}
    assert len(same) == 1
    assert toxicity.detect(none, labels).count() == 0
    assert toxicity.detect(odd, labels.where("false")).count() == 0  # no model


def test_language(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id in (900_001, 900_002):
            assert r.predicted is None and r.bits_per_char is None and not r.accepted
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.accepted for r in got)
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(99, 1)).selectExpr("* except (lang)", "cast(null as string) as lang")
    assert langid.keep_identified(unlabelled).where("text is null or text = ''").count() == 0


def test_secrets(odd, none):
    found = secrets.scan(odd)
    assert not {900_001, 900_002, 900_003} & set(ids(found))
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert secrets.scan(clean).count() == 0
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0


def test_near_duplicates(odd, none):
    got = [(r.doc_id, r.duplicate_of) for r in neardup.near_duplicates(odd).collect()]
    mine = sorted(x for x in got if x[1] == 900_005) if (None, 900_005) not in got else sorted(x for x in got if x[1] == 900_005 and x[0] is not None)
    assert mine == [(900_005, 900_005), (900_006, 900_005), (900_007, 900_005)] and (None, 900_005) in got
    assert not {900_001, 900_002, 900_003, 900_009} & {x[0] for x in got}
    left = neardup.deduplicate(odd)
    assert left.columns == odd.columns and left.count() == odd.count() - len(got)
    assert ids(left.where("doc_id >= 900000")).count(900_005) == 1 and {900_001, 900_002, 900_003} <= set(ids(left))
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicate(none).count() == 0


def test_decontamination(odd, none, benchmark, spark):
    item = benchmark.orderBy("item_id").first()
    rows = [(1, item.text), (2, None), (3, ""), (None, item.text), (1, item.text)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("item_id", benchmark_free())
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted([(1, item.item_id), (None, item.item_id)], key=str)
    left = decontaminate.decontaminate(docs, benchmark)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3"] and left.columns == docs.columns
    odd_items = benchmark.union(spark.createDataFrame([(None, None), (7777, ""), (7778, "two words"), (7779, item.text), (7780, item.text)], benchmark.schema))
    assert {7779, 7780, item.item_id} <= {r.item_id for r in decontaminate.contaminated(docs, odd_items).collect()}
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.where("false")).count() == 0
    assert decontaminate.decontaminate(odd, benchmark.where("false")).count() == odd.count()


def benchmark_free():
    from pyspark.sql import functions as F

    return F.lit("own item_id")


def test_mixing(odd, none):
    got = mixing.mix(odd)
    added = got.columns[len(odd.columns) :]
    assert got.columns[: len(odd.columns)] == odd.columns and added == ["epoch_", "block_", "position_"]
    assert got.where("text is null or trim(text) = ''").count() == 0
    assert "src3" in {r.source for r in got.select("source").distinct().collect()}
    small = odd.where("length(text) < 20000").selectExpr("* except (source)", "nullif(source, 'src3') as source")
    assert None in {r.source for r in mixing.mix(small).select("source").distinct().collect()}
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("text is null")).count() == 0


def test_language_model(odd, none):
    got = {(r.doc_id, r.n_tokens): r for r in lm.score(odd, vocabulary=300, rounds=1, hidden=16).collect()}
    assert (900_001, 1) in got and (900_002, 1) in got and (900_004, 150_001) in got
    assert all(r.log_likelihood < 0 for r in got.values())
    assert lm.score(none, vocabulary=300, rounds=1, hidden=16).count() == 0


def test_token_counts(odd, none):
    got = {(r.doc_id, r.n_bytes): r for r in tokens.token_counts(odd, chunk=20_000, overlap=200).collect()}
    assert got[900_001, None].n_tokens is None and got[900_002, 0].n_tokens == 0
    assert next(r for r in got.values() if r.doc_id == 900_004).chunks > 1
    assert tokens.token_counts(none).count() == 0


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.001]), (2, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, float("nan"), 0.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0, 0.0]), (9, [1.0, None, 0.0]), (10, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").selectExpr("*", "'x' as vec_a", "'x' as vec_b", "'x' as cell", "'x' as id")
    df = df.selectExpr("*", "'x' as node", "'x' as root", "'x' as v")
    assert sorted((r.vec_id, r.class_id, r.members) for r in embeddup.classes(df).collect()) == [(1, 1, 2), (2, 1, 2), (7, 7, 1), (8, 8, 1)]
    assert embeddup.classes(df.where("false")).count() == 0
    assert embeddup.classes(df.where("vec_id > 2 and vec_id < 7")).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, "http://b/", ""), (3, "http://c/", None), (None, "http://d/", "é" * 300_000), (5, None, "<p>y</p>")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").selectExpr("*", "'x' as payload", "'x' as headers", "'x' as warc_type")
    got = sorted(((r.page_id, r.url, r.bytes) for r in warc.round_trip(pages, f"file://{tmp_path}/w").collect()), key=str)
    assert got == sorted([(1, "http://a/", 8), (1, "http://a/", 8), (2, "http://b/", 0), (3, "http://c/", 0), (None, "http://d/", 600_000), (5, None, 8)], key=str)
    assert warc.round_trip(pages.where("false"), f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stage_keeps_columns(spark, odd, none, stage):
    import corpus_pipeline

    _, f = corpus_pipeline.STAGES[stage]
    for docs in (odd, none):
        got = f(spark, docs, "/root/testdata/sf0.001")
        assert got.columns[: len(odd.columns)] == odd.columns and (stage == 4 or len(got.columns) == len(odd.columns))
        assert got.count() <= 3 * docs.count()


@pytest.mark.parametrize("kind", ["odd", "none", "unlabelled"])
def test_pipeline_as_a_whole(spark, odd, none, benchmark, tmp_path, kind):
    import corpus_pipeline

    docs = {"odd": odd, "none": none, "unlabelled": odd.where("length(text) < 20000 or text is null").withColumn("lang", F.lit(None).cast("string"))}[kind]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (benchmark.where("false") if kind == "unlabelled" else benchmark).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns[: len(docs.columns)] == docs.columns and len(got.columns) == len(docs.columns) + 3
    rows = got.collect()
    assert (kind == "none") == (not rows)
    assert all(r.text and r.text.strip() for r in rows)
    assert sum(r.doc_id in (900_005, 900_006, 900_007) and r.epoch_ == 0 for r in rows) <= 1  # equal texts: the least id, once an epoch
