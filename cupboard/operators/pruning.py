"""Key filters of history files: which files of a table can hold a key of a batch.

For every file of an appended batch its rows' first and last purchase date and a Bloom filter of each duplicate rule's keys
are kept beside the commit record. A new batch is compared with the files whose dates and filters meet its keys; a
filter may name a file too many, never one too few, so the result is the same as with the whole history.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cupboard.operators.dedupe import COMPOSITE_KEY, ORDER_KEY, is_blank
from cupboard.operators.load import append_batch, newest_batches, read_table, record_beside, recorded_beside
from cupboard.session import write_and_reload

HASHES, BITS_PER_KEY, CHUNK_WORDS = 5, 10, 8192
_FILTERS = "file_name string, rule string, n long, first_day date, last_day date, bits long, chunk int, words binary"
_KEYS = "file_name string, rule string, h long, n long, first_day date, last_day date"


def _rule_keys() -> Column:
    """(rule, h) of each duplicate rule that a purchase row takes part in."""
    by_order = F.when(~is_blank("order_id"), F.struct(F.lit("order").alias("rule"), F.xxhash64(*ORDER_KEY).alias("h")))
    whole = ~is_blank("item_name") & F.col("purchase_date").isNotNull() & F.col("price").isNotNull()
    # -0.0 and 0.0 are one price.
    parts = [F.col(c) + 0.0 if c == "price" else F.col(c) for c in COMPOSITE_KEY]
    by_composite = F.when(whole, F.struct(F.lit("composite").alias("rule"), F.xxhash64(*parts).alias("h")))
    return F.array_compact(F.array(by_order, by_composite))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of a power of two bits."""
    h = h.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def _set_bits(words: np.ndarray, slots: np.ndarray) -> None:
    np.bitwise_or.at(words, (slots >> np.uint64(6)).ravel().astype(np.int64), (np.uint64(1) << (slots & np.uint64(63))).ravel())


def _filters(rows: DataFrame) -> DataFrame:
    """Filter rows (_FILTERS) of the files that ``rows`` (with ``file_name``) come from; a file's keys go through one task."""
    keys = rows.select("file_name", "purchase_date", F.inline(_rule_keys()))
    sizes = write_and_reload(keys.groupBy("file_name", "rule").agg(
        F.count("*").alias("n"), F.min("purchase_date").alias("first_day"), F.max("purchase_date").alias("last_day")))
    joined = keys.drop("purchase_date").join(sizes, ["file_name", "rule"]).select(*[c.split()[0] for c in _KEYS.split(", ")])
    dealt = joined.repartition("file_name", "rule").sortWithinPartitions("file_name", "rule")

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, None
        for batch in batches:
            frame = batch.to_pandas()
            for key, part in frame.groupby(["file_name", "rule"], sort=True):
                first = part.iloc[0]
                if now is None or key != (now.file_name, now.rule):
                    if now is not None:
                        yield rows_of(now, words)
                    now, words = first, np.zeros(max(1, (1 << max(6, int(BITS_PER_KEY * first.n - 1).bit_length())) // 64), np.uint64)
                _set_bits(words, _slots(part["h"].to_numpy(), 64 * len(words)))
        if now is not None:
            yield rows_of(now, words)

    def rows_of(of, words: np.ndarray) -> pa.RecordBatch:
        chunks = [words[at:at + CHUNK_WORDS].astype("<u8").tobytes() for at in range(0, len(words), CHUNK_WORDS)]
        k = len(chunks)
        columns = [pa.array([of.file_name] * k), pa.array([of.rule] * k), pa.array([int(of.n)] * k, pa.int64()), pa.array([of.first_day] * k, pa.date32()),
                   pa.array([of.last_day] * k, pa.date32()), pa.array([64 * len(words)] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(chunks, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FILTERS.split(", ")])

    return dealt.mapInArrow(build, _FILTERS)


PART = "_filters"


def _path(path: str) -> str:
    return f"{path.rstrip('/')}/{PART}"


def _file_name() -> Column:
    """The part of a file's path below ``rows/``, as long as the table stays whole."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/rows/(.*)$", 1)


def append_with_filters(
    rows: DataFrame, path: str, schema: T.StructType, batch_id: str, as_of: Column, partition: str | None = None, **options,
) -> None:
    """``append_batch``, then the filters of the files it wrote. Only those files are read. A record follows
    the filters; if a run ends before it, the batch counts as without filters, and its files are always opened until it is run again."""
    spark = rows.sparkSession
    append_batch(rows, path, schema, batch_id, as_of, partition, **options)
    newest = newest_batches(spark, path).where(F.col("batch_id") == batch_id).first()
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType()), T.StructField("version", T.LongType())])
    written = spark.read.schema(full).parquet(f"{path}/rows").where(
        (F.col("batch_id") == batch_id) & (F.col("version") == newest["version"]))
    filters = _filters(written.select(_file_name().alias("file_name"), *COMPOSITE_KEY, "order_id"))
    filters.withColumns({"batch_id": F.lit(batch_id), "version": F.lit(newest["version"])}).write.mode("append").partitionBy(
        "batch_id", "version").parquet(_path(path))
    record_beside(spark, path, PART, batch_id, newest["version"])


def possible_files(spark: SparkSession, path: str, batch: DataFrame, max_keys: int = 2_000_000) -> DataFrame | None:
    """(file_name) of the published files that can hold a key of ``batch``, from filters alone; None without any filter.

    The batch's different keys are sent to the filters if there are at most ``max_keys`` (16 MB); a larger batch is met by the
    files whose dates it reaches. Files of batches without filters are not listed.
    """
    whole = recorded_beside(spark, path, PART)
    if whole is None:
        return None
    table = spark.read.schema(_FILTERS + ", batch_id string, version long").parquet(_path(path))
    live = table.join(whole, ["batch_id", "version"], "left_semi")
    keys = write_and_reload(batch.select("purchase_date", F.inline(_rule_keys())).groupBy("rule", "h").agg(
        F.min("purchase_date").alias("first"), F.max("purchase_date").alias("last")))
    days = keys.where("rule = 'composite'").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n")).first()
    # The composite key holds the date, the order key does not.
    in_days = (F.col("rule") == "order") | (F.col("first_day") <= F.lit(days["last"])) & (F.col("last_day") >= F.lit(days["first"]))
    live = live.where(F.coalesce(in_days, F.lit(False)))
    if keys.limit(max_keys + 1).count() > max_keys:
        return live.select("file_name").distinct()
    found = keys.select("rule", "h").toArrow().to_pandas()  # max_keys at most
    hashes = spark.sparkContext.broadcast({rule: part["h"].to_numpy() for rule, part in found.groupby("rule")})
    names = ("file_name", "rule", "bits", "chunk", "words")
    dealt = live.select(*names).repartition("file_name", "rule").sortWithinPartitions("file_name", "rule", "chunk")

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            hits = []
            for file_name, rule, bits, _, words in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now is not None and (file_name, rule) != now[:2]:
                    hits += held(now, parts)
                    parts = []
                now = (file_name, rule, bits)
                parts.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string())], names=["file_name"])
        yield pa.RecordBatch.from_arrays([pa.array(held(now, parts) if now else [], pa.string())], names=["file_name"])

    def held(of: tuple, parts: list[bytes]) -> list[str]:
        words = np.frombuffer(b"".join(parts), "<u8")
        asked = hashes.value.get(of[1], np.empty(0, np.int64))
        for at in range(0, len(asked), 100_000):
            slots = _slots(asked[at:at + 100_000], of[2])
            if ((words[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)).all(axis=1).any():
                return [of[0]]
        return []

    return dealt.mapInArrow(probe, "file_name string").distinct()


def read_matching(spark: SparkSession, path: str, schema: T.StructType, batch: DataFrame, max_keys: int = 2_000_000) -> DataFrame | None:
    """The table's rows in files that can hold a key of ``batch``: enough to compare it with (``dedupe.accept_new``).

    The names of the files to open become the scan's file filter, so others are not opened; Spark's planner holds the list
    of all files anyway. Batches without filters are read whole. None if nothing was published yet.
    """
    table = read_table(spark, path, schema)
    files = possible_files(spark, path, batch, max_keys)
    if table is None or files is None:
        return table
    names = [r["file_name"] for r in files.collect()]
    rows = read_table(spark, path, schema, only=_file_name().isin(names))
    whole = recorded_beside(spark, path, PART)
    bare = [r["batch_id"] for r in newest_batches(spark, path).join(whole, ["batch_id", "version"], "left_anti").collect()]
    return rows.unionByName(read_table(spark, path, schema, only=F.col("batch_id").isin(bare))) if bare else rows
