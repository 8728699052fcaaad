"""Rows of a table of documents by key: id and hash of the text, either of which may be null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys up to so many are broadcast (about 24 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key_id, key_text and text only, whatever the other columns are called."""
    return docs.select(key_id(docs[id_col]).alias("key_id"), key_text(docs[text_col]).alias("key_text"), docs[text_col].cast("string").alias("text"))


def key_id(column):
    return F.coalesce(column.cast("long"), F.lit(_NO_ID))


def key_text(column):
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("")))


def id_of(column):
    """The id in a key, null again where it was."""
    return F.when(column != _NO_ID, column)


def without(docs: DataFrame, keys: DataFrame, count: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose key is not among keys(key_id, key_text), of which there are `count`; columns as they were."""
    return _against(docs, keys, count, id_col, text_col, "left_anti")


def within(docs: DataFrame, keys: DataFrame, count: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _against(docs, keys, count, id_col, text_col, "left_semi")


def _against(docs: DataFrame, keys: DataFrame, count: int, id_col: str, text_col: str, how: str) -> DataFrame:
    if count <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    on = (key_id(docs[id_col]) == keys["key_id"]) & (key_text(docs[text_col]) == keys["key_text"])
    return docs.join(keys, on, how)
