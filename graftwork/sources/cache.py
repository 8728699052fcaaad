"""Results kept by content in a Parquet table: hits by semi join, misses by anti join, misses appended."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.operators import code
from graftwork.parse import Limits

VERSION = 1


def diff_key(pairs: DataFrame, logic_only: bool, limits_key: str) -> DataFrame:
    """Adds cache_key: both contents, path, options and version of the format."""
    part = lambda c: F.coalesce(F.sha2(c, 256), F.lit("-"))
    return pairs.withColumn("cache_key", F.sha2(F.concat_ws(":", part("old_text"), part("new_text"), "file_path", "lang", F.lit(str(logic_only)), F.lit(limits_key), F.lit(str(VERSION))), 256))


def through(keyed: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for all rows of keyed: read for keys that are stored, computed for the others, which are stored then.

    compute takes rows and returns results with their cache_key.
    """
    spark = keyed.sparkSession
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    missing = keyed.join(spark.read.parquet(path).select("cache_key").distinct(), "cache_key", "left_anti") if exists else keyed
    compute(missing.dropDuplicates(["cache_key"])).write.mode("append").parquet(path)
    return keyed.select("cache_key").distinct().join(spark.read.parquet(path), "cache_key")


def diffs(pairs: DataFrame, path: str, logic_only: bool = False, limits: Limits | None = None) -> DataFrame:
    """code.file_diffs() of the pairs, compared only where the table at the path doesn't have them yet."""
    limits = limits or Limits()
    keyed = diff_key(code._changed(pairs), logic_only, limits.key())

    def compute(rows: DataFrame) -> DataFrame:
        done = code.file_diffs(rows, logic_only, limits)
        return done.join(rows.select("commit", "file_path", "cache_key"), ["commit", "file_path"])

    found = through(keyed, path, compute).drop("commit", "file_path")
    return keyed.select("commit", "file_path", "cache_key").join(found, "cache_key").drop("cache_key")


def trees(files: DataFrame, path: str, logic_only: bool = False, limits: Limits | None = None) -> DataFrame:
    """code.nodes() of files(file_path, lang, text), by content: equal texts are parsed once, and not again where the table at the path has them. id is the file's path."""
    limits = limits or Limits()
    some = files.where(files["text"].isNotNull()).select("file_path", "lang", "text")
    key = F.sha2(F.concat_ws(":", F.sha2("text", 256), "lang", F.lit(str(logic_only)), F.lit(limits.key()), F.lit(str(VERSION))), 256)
    keyed = some.withColumn("cache_key", key)
    found = through(keyed, path, lambda rows: code.nodes(rows, "cache_key", "text", rows["lang"], logic_only, limits).withColumnRenamed("id", "cache_key"))
    return keyed.select(F.col("file_path").alias("id"), "cache_key").join(found, "cache_key").drop("cache_key")


def stats(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count("*").alias("entries"), F.countDistinct("cache_key").alias("keys"))


def safe_key(key: str) -> bool:
    return bool(re.fullmatch("[0-9a-f]+", key))
