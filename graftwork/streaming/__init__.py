"""An extension: a stream of changed files, each micro-batch compared and its results appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graftwork.operators import code


def compare_stream(pairs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the operations of each batch of pairs to a folder of its own, so that a batch that is run again replaces its rows."""

    def batch(df: DataFrame, number: int) -> None:
        code.operations(code.file_diffs(df)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
