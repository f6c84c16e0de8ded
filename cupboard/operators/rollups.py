"""Purchases summed by day, kept beside the purchase table batch by batch, so that spending queries need not read it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cupboard import schemas
from cupboard.operators.load import append_batch, read_table
from cupboard.session import write_and_reload

KEYS = ("purchase_date", "source", "currency", "category", "possession_id")
SUMS = T.StructType([
    T.StructField("purchase_date", T.DateType()), T.StructField("source", T.StringType()), T.StructField("currency", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("possession_id", T.LongType()),
    T.StructField("n", T.LongType(), False), T.StructField("s", T.DoubleType()),
])


def sums_of(purchases: DataFrame) -> DataFrame:
    """Number ``n`` and price sum ``s`` by day, source, currency and category; the possession is kept only where there is no
    category, as its own then counts. A third of all purchases in one group is one row a task before the shuffle."""
    owned = F.when(F.col("category").isNull(), F.col("possession_id")).alias("possession_id")
    rows = purchases.select(*KEYS[:-1], owned, "price")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("price").alias("s"))


def _sums_path(path: str) -> str:
    return f"{path.rstrip('/')}/_sums"


def append_with_sums(rows: DataFrame, path: str, batch_id: str, as_of: Column, partition: str | None = "source") -> None:
    """Append a batch to the purchase table, then its sums to the table of sums.

    Both replace what an earlier run of the batch left, so the sums of a replaced batch are out again. A run that ends
    between the two leaves the old sums; running the batch again brings them in line. Only the batch is read.
    """
    staged = write_and_reload(rows)
    append_batch(staged, path, schemas.PURCHASE_HISTORY, batch_id, as_of, partition=partition)
    append_batch(sums_of(staged), _sums_path(path), SUMS, batch_id, as_of, keep_ids=True)


def read_sums(spark: SparkSession, path: str) -> DataFrame | None:
    """The sums of all published batches, several rows of equal keys included; the spending queries of
    ``plans.analytics`` take them in place of the purchases. None before the first batch."""
    return read_table(spark, _sums_path(path), SUMS)
