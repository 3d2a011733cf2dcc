"""Tokenizing and encoding of texts as they arrive.

Both work on each row alone, so any plan of functions/ and operators/ without a join of rows runs on a stream as it
does on a table: no state, no watermark. incremental() reads the files of a folder once each and appends results.
Offsets and commits lie in the checkpoint folder, which must be shared by the cluster: a run that was cut short goes on there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def incremental(
    spark: SparkSession,
    source: str,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    schema: str = "doc_id long, text string",
    files: int = 1000,
    once: bool = True,
) -> StreamingQuery:
    """Start a query that appends transform(new rows of the Parquet files in source) to sink, ``files`` files at a time.

    With once it ends when all files that lie there have been read, else it waits for more. Empty folders give no rows.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    out = transform(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start(sink)
