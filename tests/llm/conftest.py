import random

import pytest
from llm_data import SF, VOCABULARY, sentence
from pyspark.sql import functions as F

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
#: Columns of names that the operators use inside, to clash with.
CLASHES = ("key_id", "key_text", "node", "features", "bands", "word", "n", "of", "block", "epoch", "position", "_p", "token", "labels", "toxic", "predicted", "band", "hash", "item_id")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty texts, one very long text, repeated rows, one id of two texts."""
    g = random.Random(5)
    long = " ".join(g.choice(VOCABULARY) for _ in range(150_000))
    twice = sentence(g, 60)
    return [
        (None, None, None, None, None), (900_001, None, "en", "src1", None), (900_002, "", "en", "src1", 0), (900_003, " \n\t ", None, "src2", 4), (900_004, long, "en", None, len(long)),
        (900_005, twice, "en", "src3", len(twice)), (900_005, twice, "en", "src3", len(twice)), (900_006, twice, None, "src3", len(twice)), (900_007, twice, "en", "src4", len(twice)), (None, twice, "en", "src3", len(twice)),
        (900_008, sentence(g, 40), "en", "src3", 1), (900_008, sentence(g, 40), "en", "src3", 1), (900_009, "!!! ... ???", "en", "src3", 11),
    ]


@pytest.fixture(scope="session")
def odd(spark, documents, odd_rows, tmp_path_factory):
    """The documents and the odd rows, with columns of clashing names."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df = documents.select(*[c.split()[0] for c in SCHEMA.split(", ")]).union(spark.createDataFrame(odd_rows, SCHEMA))
    df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd):
    """No rows, same columns."""
    return odd.where("false")
