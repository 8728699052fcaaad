"""A training corpus out of `documents`, in five stages; each works on all that its predecessor kept.

Documents without an identified language go; of near duplicates one stays;
documents that hold benchmark items go; secrets are replaced; sources are mixed
to target weights, which adds the columns epoch, block and position.

Defined results: null and empty texts have no language and go in the first stage (where no row is labelled
with a language, texts that aren't empty all stay); a null language takes no part in training and is judged like any other; a null id is an id
of its own; of rows equal in id and text, and of equal or near texts, one stays, the least id; a null
source is a source of its own; texts of any length are judged whole; an empty table of documents gives
an empty table of the same columns, an empty benchmark lets every document stay; ties are settled as in the
stages' modules; further columns are kept as they are, and epoch, block and position get underscores
after their names where these are taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graftwork.llm import decontaminate, langid, mixing, neardup, secrets
from graftwork.storage import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


#: Kneser-Ney models, weighted sampling and checksums are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
