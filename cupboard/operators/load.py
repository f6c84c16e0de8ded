"""Import of a landing folder: scan, map, normalise, suppress duplicates, append, count."""

from __future__ import annotations

import secrets
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cupboard.operators.dedupe import accept_by_order, accept_new, is_blank
from cupboard.operators.normalize import Importer, to_purchases
from cupboard.session import prepare, scratch_dir, write_and_reload
from cupboard.sources.exports import ROW_ORDER, broken_records, file_headers, number_files, profile_files, read_cells


@dataclass(frozen=True)
class Import:
    """Accepted rows, rows and files set aside, and counts per file."""

    accepted: DataFrame
    rejected: DataFrame
    statistics: DataFrame


def stage_exports(spark: SparkSession, path: str | list[str], importer: Importer) -> tuple[DataFrame, DataFrame]:
    """Files with their mapping, and typed rows in file order; both written to the shared scratch folder.

    Writing fixes the row ids, so that a lost executor cannot change which row is first.
    """
    prepare(spark)
    base = scratch_dir(spark)
    profiles = write_and_reload(profile_files(spark, path, importer.charsets), f"{base}/profiles")
    records = broken_records(spark, path, profiles, importer.charsets)
    files = importer.map_headers(file_headers(profiles, records, importer.charsets))
    known = F.col("charset").isNotNull() & F.col("header").isNotNull()
    if importer.needs_known_header:
        known = known & F.col("variant").isNotNull()
    files = write_and_reload(number_files(files.withColumn("is_error", ~known)), f"{base}/files")
    # One row per file; broadcast only below Spark's size threshold, else joined with skew splitting.
    usable = files.filter("NOT is_error").drop("is_empty", "bare_cr", "single", "is_error", "names")
    rows = read_cells(spark, path, usable, records, importer.charsets).drop("charset", "multi_line")
    return files, write_and_reload(to_purchases(rows, importer), f"{base}/rows")


def import_exports(
    spark: SparkSession, path: str | list[str], target: DataFrame | None, importer: Importer
) -> Import:
    """Import every file below ``path`` against the purchases already in ``target`` (None: none yet)."""
    files, staged = stage_exports(spark, path, importer)
    rows = staged.filter("NOT is_error")
    empty = is_blank("item_name") & F.col("price").isNull()
    if importer.drops_empty_rows:
        rows = rows.filter(~empty)
    accept = accept_new if importer.compares_composite else accept_by_order
    accepted = write_and_reload(accept(rows, target, ROW_ORDER))

    dropped = empty & ~F.col("is_error") if importer.drops_empty_rows else F.lit(False)
    seen = staged.groupBy("file_path").agg(
        F.count_if(~F.col("is_error") & ~dropped).alias("rows"), F.count_if("is_error").alias("row_errors")
    )
    kept = accepted.groupBy("file_path").agg(F.count("*").alias("kept"))
    zero = F.lit(0).cast("long")
    imported = F.coalesce("kept", zero)
    statistics = (
        files.join(seen, "file_path", "left").join(kept, "file_path", "left").select(
            "file_path", "format_key", *[c for c in ("format_name",) if c in files.columns],
            imported.alias("imported"),
            (F.coalesce("rows", zero) - imported).alias("skipped"),
            (F.coalesce("row_errors", zero) + F.col("is_error").cast("long")).alias("errors"),
        )
    )
    rejected = staged.filter("is_error").select("file_path", F.lit("short_row").alias("reason"), "raw_data").unionByName(
        files.filter("is_error").select(
            "file_path",
            F.when(F.col("is_empty"), "empty_file").when(F.col("charset").isNull(), "undecodable")
            .otherwise("unknown_header").alias("reason"),
            F.lit(None).cast("string").alias("raw_data"),
        )
    )
    return Import(accepted, rejected, statistics)


def _placed(rows: DataFrame) -> DataFrame:
    """The rows, written once with their task and place."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return write_and_reload(rows.withColumns({"_task": F.spark_partition_id(), "_place": place}))


def with_ids(rows: DataFrame, first_id: int = 1) -> DataFrame:
    """Consecutive ids from ``first_id``.

    The rows are written once with their task and place, the counts per task give each task its first id.
    """
    return _numbered(_placed(rows), first_id)


def _numbered(staged: DataFrame, first_id: int) -> DataFrame:
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged.groupBy("_task").agg(F.count("*").alias("_n"))  # one row per task
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # The rows stay where they are; a join by size would shuffle them, as the planner takes the counts for large.
    return staged.join(F.broadcast(offsets), "_task").withColumn("id", F.col("_before") + F.col("_place") + first_id).drop(
        "_task", "_place", "_n", "_before")


def next_id(table: DataFrame) -> int:
    highest = table.agg(F.max("id")).first()[0]
    return 1 if highest is None else highest + 1


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns, order and types of a table; columns the rows lack become NULL."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


class ConstraintError(ValueError):
    """Rows that a table must not hold."""


# One record per published batch: the version of its files that counts, and the highest id given out so far.
_COMMITS = "batch_id string, version long, last_id long"


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_COMMITS).parquet(f"{path}/_commits")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def highest_id(spark: SparkSession, path: str) -> int:
    """The highest id that the table's batches were given, 0 for a new table."""
    past = _commits(spark, path)
    return 0 if past is None else past.agg(F.max("last_id")).first()[0] or 0


def append_batch(
    rows: DataFrame, path: str, schema: T.StructType, batch_id: str, as_of: Column, partition: str | None = None,
    sort: tuple[str, ...] = ("purchase_date",), keep_ids: bool = False, in_place: bool = False,
) -> None:
    """Append one batch; running the same batch again replaces all of it, whatever partitions it had.

    The files of a run go to a folder of their own, whose number no run before it can have had. One small commit record then
    makes them the batch's rows, so a reader sees either run as a whole, and of a run that ends before its record nothing is
    ever seen, also after the next one. Ids go on after the highest one given
    out, which the record keeps: the history is not read. With ``keep_ids`` the rows bring theirs, above
    ``highest_id``. With ``in_place`` each task writes its rows without a shuffle, for rows that come in parts of a good size, such
    as the splits of a written table. A table has one writer at a time. NULLs in required columns and blank partition values raise
    ConstraintError before anything is published.
    """
    spark = rows.sparkSession
    past = _commits(spark, path)
    version, last_id = past.agg(F.max("version"), F.max("last_id")).first() if past is not None else (0, 0)
    # Above all published ones, and by chance apart from those of runs that wrote files but no record.
    version, last_id = (version or 0) + 1 + secrets.randbelow(1 << 32), last_id or 0
    if "created_at" in schema.fieldNames():
        rows = rows.withColumn("created_at", as_of)
    batch = conform(rows, schema)
    numbers = "id" in schema.fieldNames() and not keep_ids
    if numbers:
        batch = _placed(batch.drop("id"))
    required = [f.name for f in schema.fields if not f.nullable and not (numbers and f.name == "id")]
    broken = reduce(Column.__or__, [F.col(c).isNull() for c in required], F.lit(False))
    if partition:
        broken = broken | F.col(partition).isNull() | (F.trim(F.col(partition).cast("string")) == "")
    highest = F.count("*") + last_id if numbers else F.max("id") if keep_ids and "id" in schema.fieldNames() else F.lit(None).cast("long")
    found = batch.agg(F.count_if(broken), highest).first()
    if found[0]:
        raise ConstraintError(f"{found[0]} rows of batch {batch_id} lack a required value")
    if numbers:
        batch = conform(_numbered(batch, last_id + 1), schema)
    keys = ["batch_id", "version"] + ([partition] if partition else [])
    batch = batch.withColumns({"batch_id": F.lit(batch_id), "version": F.lit(version).cast("long")})
    if not in_place:
        # Splits a partition value that holds most rows into several files, and merges small ones.
        batch = batch.hint("rebalance", *keys)
    # Sorted files let readers skip row groups.
    (
        batch.sortWithinPartitions(*keys, *[c for c in sort if c in batch.columns])
        .write.mode("append").partitionBy(*keys).parquet(f"{path}/rows")
    )
    record = spark.range(1).select(
        F.lit(batch_id).alias("batch_id"), F.lit(version).cast("long").alias("version"),
        F.lit(max(last_id, found[1] or 0)).cast("long").alias("last_id"))
    record.coalesce(1).write.mode("append").parquet(f"{path}/_commits")


def newest_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch_id, version) of the published batches, or None if there are none."""
    commits = _commits(spark, path)
    return None if commits is None else commits.groupBy("batch_id").agg(F.max("version").alias("version"))


def record_beside(spark: SparkSession, path: str, part: str, batch_id: str, version: int) -> None:
    """Record that what is kept beside the table in ``part`` is whole for a run of a batch."""
    record = spark.createDataFrame([(batch_id, version)], "batch_id string, version long")
    record.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/{part}_commits")


def recorded_beside(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """(batch_id, version) of the published batches whose ``part`` is whole; None if there is no such record."""
    newest = newest_batches(spark, path)
    try:
        records = spark.read.schema("batch_id string, version long").parquet(f"{path.rstrip('/')}/{part}_commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if newest is None else newest.join(records, ["batch_id", "version"], "left_semi")


def read_table(spark: SparkSession, path: str, schema: T.StructType, only: Column | None = None) -> DataFrame | None:
    """The published rows of a table written by ``append_batch``, or None if nothing was published yet. ``only`` restricts
    them, by ``_metadata`` or ``batch_id`` before files are opened."""
    newest = newest_batches(spark, path)
    if newest is None:
        return None
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType()), T.StructField("version", T.LongType())])
    try:
        rows = spark.read.schema(full).parquet(f"{path}/rows")
    except AnalysisException as error:  # only empty batches so far
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full).select(*schema.fieldNames(), "batch_id")
    if only is not None:
        rows = rows.where(only)
    # Both are partition columns, so files of replaced runs are not opened.
    return rows.join(newest, ["batch_id", "version"], "left_semi").select(*schema.fieldNames(), "batch_id")
