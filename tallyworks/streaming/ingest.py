"""Invoices from a folder as they arrive.

The file source remembers the paths it has seen. Each micro-batch goes through the same import as a
batch job, and the ledger's own hash check decides what is new, so a replayed batch adds nothing.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, content) of files as they come."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder).select("path", "content")


def ingest_stream(
    files: DataFrame, import_batch: Callable[[DataFrame, datetime.date], DataFrame], checkpoint: str, today: Callable[[], datetime.date] = datetime.date.today,
    available_now: bool = True,
) -> StreamingQuery:
    """Starts a query that imports every micro-batch."""

    def each(batch: DataFrame, _: int) -> None:
        import_batch(batch, today())

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
