"""Trigram lists of a table's texts: which rows can hold the letters of a LIKE pattern.

For every file of an appended batch the rows of each trigram (three letters in a row, case folded) are kept beside the commit
record, in lists of at most ``BLOCK`` rows. A pattern's letters between its wildcards give trigrams that a match must hold; the
intersection of their lists names the rows to look at, and LIKE decides. Lists may name a row too many, never one too few.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cupboard.functions.text import like
from cupboard.operators.load import append_batch, newest_batches, read_table, record_beside, recorded_beside
from cupboard.session import write_and_reload

# Rows whose ids agree but for their last 16 bits share a list, which bounds it and makes its entries small.
BLOCK = 1 << 16
_LISTS = "gram string, field string, file_name string, block long, places array<int>"
_STORED = f"{_LISTS}, batch_id string, version long"


PART = "_trigrams"


def _path(path: str) -> str:
    return f"{path.rstrip('/')}/{PART}"


def _file_name() -> Column:
    """The part of a file's path below ``rows/``, as long as the table stays whole."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/rows/(.*)$", 1)


def _grams(text: Column) -> Column:
    """The different trigrams of a text; none for NULL and shorter texts."""
    folded = F.lower(text)
    starts = F.when(F.char_length(folded) >= 3, F.sequence(F.lit(1), F.char_length(folded) - 2))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(folded, i, F.lit(3))))


def _lists(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Lists (_LISTS) of ``rows`` (with ``file_name`` and ``id``). A trigram of a third of all rows is one list per file and
    block, so no group holds more than ``BLOCK`` rows."""
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    told = rows.select("file_name", "id", texts.alias("t"))
    held = told.select("file_name", "id", F.col("t.field").alias("field"), F.explode(_grams(F.col("t.text"))).alias("gram"))
    block = F.shiftright("id", 16).alias("block")
    place = F.col("id").bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    return held.groupBy("gram", "field", "file_name", block).agg(F.sort_array(F.collect_set(place)).alias("places"))


def append_with_trigrams(
    rows: DataFrame, path: str, schema: T.StructType, batch_id: str, as_of: Column, fields: tuple[str, ...], **options,
) -> None:
    """``append_batch`` in the order of ids, then the trigram lists of ``fields`` in the files it wrote; only those are read.

    A record follows the lists. If a run ends before it, the batch counts as without lists, and its files are always searched until it is run again. Rows without an
    id raise ConstraintError.
    """
    spark = rows.sparkSession
    named = T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name != "id") for f in schema.fields])
    append_batch(rows, path, named, batch_id, as_of, sort=("id",), **options)
    newest = newest_batches(spark, path).where(F.col("batch_id") == batch_id).first()
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.StringType()), T.StructField("version", T.LongType())])
    written = spark.read.schema(full).parquet(f"{path}/rows").where(
        (F.col("batch_id") == batch_id) & (F.col("version") == newest["version"]))
    lists = _lists(written.select(_file_name().alias("file_name"), "id", *fields), fields)
    # Sorted, so that a reader of a few trigrams skips most pages of each file.
    lists.sortWithinPartitions("gram", "field").withColumns({"batch_id": F.lit(batch_id), "version": F.lit(newest["version"])}).write.mode(
        "append").partitionBy("batch_id", "version").parquet(_path(path))
    record_beside(spark, path, PART, batch_id, newest["version"])


def pattern_grams(spark: SparkSession, pattern: str) -> list[str]:
    """The trigrams every match of a LIKE pattern holds. Spark folds the case, as it does for the texts."""
    folded = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    runs = re.split("[%_]", folded)
    return sorted({run[i:i + 3] for run in runs for i in range(len(run) - 2)})


def _live_lists(spark: SparkSession, path: str) -> DataFrame | None:
    """Lists of the published batches that have whole lists, or None if no batch ever had."""
    whole = recorded_beside(spark, path, PART)
    if whole is None:
        return None
    return spark.read.schema(_STORED).parquet(_path(path)).join(whole, ["batch_id", "version"], "left_semi")


def candidates(spark: SparkSession, path: str, fields: tuple[str, ...], pattern: str) -> DataFrame | None:
    """(file_name, id) of the rows that hold all trigrams of the pattern in one of ``fields``, each once.

    Lists meet by field, file and block, at most one of ``BLOCK`` places for each trigram. None if the pattern has no three
    letters in a row or no batch has lists: then any row can match.
    """
    grams = pattern_grams(spark, pattern)
    lists = _live_lists(spark, path) if grams else None
    if lists is None:
        return None
    wanted = lists.where(F.col("gram").isin(grams) & F.col("field").isin(*fields))
    met = wanted.groupBy("field", "file_name", "block").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(grams))
    common = F.reduce(F.slice("lists", 2, BLOCK), F.col("lists")[0], lambda kept, places: F.array_intersect(kept, places))
    found = met.select("file_name", "block", F.explode(common).alias("place"))
    return found.select("file_name", (F.col("block") * BLOCK + F.col("place")).alias("id")).distinct()


def search(
    spark: SparkSession, path: str, schema: T.StructType, fields: tuple[str, ...], pattern: str, max_ids: int = 1000,
) -> DataFrame | None:
    """The table's rows with one of ``fields`` LIKE ``pattern``, cases folded; None if nothing was published yet.

    Only files with a candidate are opened; up to ``max_ids`` candidates are also handed to the scan by id, so that it skips
    the pages between them (files are sorted by id). LIKE decides on every row read, so the result is that of a full scan.
    """
    table = read_table(spark, path, schema)
    if table is None:
        return None
    matches = reduce(Column.__or__, [like(f, pattern) for f in fields])
    found = candidates(spark, path, fields, pattern)
    if found is None:
        return table.where(matches)
    found = write_and_reload(found)
    names = [r["file_name"] for r in found.select("file_name").distinct().collect()]
    ids = [r["id"] for r in found.select("id").limit(max_ids + 1).collect()]
    only = _file_name().isin(names) & matches
    if len(ids) <= max_ids:
        only = only & F.col("id").isin(ids)
    rows = read_table(spark, path, schema, only=only)
    whole = recorded_beside(spark, path, PART)
    bare = [r["batch_id"] for r in newest_batches(spark, path).join(whole, ["batch_id", "version"], "left_anti").collect()]
    return rows.unionByName(read_table(spark, path, schema, only=F.col("batch_id").isin(bare) & matches)) if bare else rows
