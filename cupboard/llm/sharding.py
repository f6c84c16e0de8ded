"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cupboard.session import write_and_reload


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and one separator; NULL has no bytes) and CRC-32 of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def byte_shards(rows: DataFrame, n_shards: int = 8) -> DataFrame:
    """Adds ``shard`` and ``slot`` to ``sized`` rows, in the order of doc_id.

    Rows are range-partitioned once and kept. The totals of the partitions give every partition its first byte and
    first row, a running sum inside the partition gives every row its own, and a row belongs to the shard that
    holds the middle of its bytes when the total is cut into equal parts. Shards are contiguous, each differs from
    its target by less than the largest row, and slots count from 0. Equal ids are ordered by checksum and size; a
    NULL id comes first; no rows give no rows. Only one row per partition is ever gathered.
    """
    order = ["doc_id", "text_crc32", "size", "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    dealt = write_and_reload(dealt.withColumn("_part", F.spark_partition_id()))

    totals = dealt.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows_before"), F.sum("bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = (
        dealt.join(offsets, "_part")
        .withColumn("_start", F.col("_bytes_before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("_row", F.col("_rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(least((2 * _start + size) * {n_shards} div (2 * _total), {n_shards} - 1) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        *rows.columns, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes the documents as one folder per shard, ``path/shard=N``, sorted by slot; ids must be unique.

    Each shard is written by several tasks, one per contiguous range of slots.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    located = docs.select(*columns).join(placed.select("doc_id", "shard", "slot"), "doc_id")
    (located.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))
