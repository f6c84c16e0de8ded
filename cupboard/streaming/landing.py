"""Continuous import: files arriving in a landing folder go through the batch import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cupboard.operators.load import append_batch, import_exports, read_table
from cupboard.operators.normalize import Importer
from cupboard.schemas import PURCHASE_HISTORY
from cupboard.session import prepare

# The file listing is the stream; contents are read by the import itself.
_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_landing(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    importer: Importer,
    stream: str,
    now: Callable[[], Column] = F.current_timestamp,
    max_files: int = 1000,
) -> StreamingQuery:
    """Import every new file below ``landing`` into the purchase table at ``table``.

    ``stream`` names this stream for good: batches are called by it and the trigger's number, so several streams
    can feed one table in turn. A replayed trigger replaces its own rows only, and its own earlier rows do not
    count as duplicates. At most ``max_files`` files go into one trigger, which bounds the path list that passes
    the driver; all files are imported, but of equal rows in different triggers the one that arrived first stays,
    not the first in path order.
    """
    prepare(spark)
    files = (
        spark.readStream.format("binaryFile").schema(_FILES)
        .option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").load(landing).select("path")
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        paths = [row.path for row in batch.orderBy("path").collect()]
        if not paths:
            return
        stored = read_table(spark, table, PURCHASE_HISTORY)
        name = f"{stream}-{batch_id}"
        target = None if stored is None else stored.filter(F.col("batch_id") != name)
        done = import_exports(spark, paths, target, importer)
        append_batch(done.accepted, table, PURCHASE_HISTORY, name, now(), partition="source")

    return (
        files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(load).start()
    )
