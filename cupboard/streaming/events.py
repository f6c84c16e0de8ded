"""Consumption events as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cupboard.session import prepare, scratch_dir


def event_stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    return prepare(spark).readStream.schema(schema).options(**options).parquet(path)


def _stored(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_to_table(
    log: DataFrame, aggregate: Callable[[DataFrame], DataFrame], path: str | None = None, key: str = "possession_id",
    merge_every: int = 16,
) -> DataFrame:
    """Run an aggregate of the log over everything available and return the table it leaves, one row per ``key``.

    A trigger writes only the rows that changed, under its batch id, so a replayed trigger replaces its own rows.
    The table is the newest row of each key; a stream without events leaves an empty table.

    Once more than ``merge_every`` triggers have left changes, the newest rows are written as one table, and one small record
    makes it the base of later reads, which then open that table and the changes after it only. A run that ends before the
    record leaves the earlier base in force. One run at a time.
    """
    spark = log.sparkSession
    path = path or scratch_dir(spark)
    result = aggregate(log)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    query = (
        result.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(save).start()
    )
    query.awaitTermination()
    schema = T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])
    changes = _stored(spark, f"{path}/changes", schema)
    if changes is None:
        return spark.createDataFrame([], result.schema)
    merges = _stored(spark, f"{path}/merges", "upto long")
    upto = None if merges is None else merges.agg(F.max("upto")).first()[0]
    rows = changes
    if upto is not None:
        # A partition column, so folders of merged changes are not opened.
        changes = changes.where(F.col("batch") > upto)
        rows = changes.unionByName(spark.read.schema(schema).parquet(f"{path}/merged-{upto}"))
    newest = Window.partitionBy(key).orderBy(F.desc("batch"))
    table = rows.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").select(*schema.fieldNames())
    last, n = changes.agg(F.max("batch"), F.count_distinct("batch")).first()
    if n > merge_every:
        table.write.mode("overwrite").parquet(f"{path}/merged-{last}")
        spark.range(1).select(F.lit(last).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{path}/merges")
        table = spark.read.schema(schema).parquet(f"{path}/merged-{last}")
    return table.select(*result.columns)
