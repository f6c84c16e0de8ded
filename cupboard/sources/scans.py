"""Scans of text lines, OCR results, images and frame detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OCR_SCHEMA = "image_path string, image_hash string, ocr_text string, words array<struct<text: string, conf: string>>"
DETECTION_SCHEMA = "array<struct<name: string, category: string, condition: string, location: string>>"


def read_item_lines(spark: SparkSession, path: str) -> DataFrame:
    """``category:name[ / brand]`` lines with their position in the folder."""
    return spark.read.text(path).select(
        "value",
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("row_id"),
    )


def read_ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per receipt image: path, content hash, text and words with confidence."""
    return spark.read.schema(OCR_SCHEMA).json(path)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image files with the SHA-256 of their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(
        F.col("path").alias("image_path"), content_hash(F.col("content")).alias("image_hash"), "length"
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def parse_detections(frames: DataFrame, column: str = "detections") -> tuple[DataFrame, DataFrame]:
    """Frame rows with a JSON array of items: (one row per item, frames whose JSON cannot be read)."""
    parsed = frames.withColumn("_items", F.from_json(column, DETECTION_SCHEMA))
    # The outer form: for the inner one Spark adds a filter that would parse every array once more.
    exploded = parsed.withColumn("_item", F.explode_outer("_items")).filter("_item IS NOT NULL")
    return exploded.select(*frames.columns, "_item.*").drop(column), parsed.filter("_items IS NULL").drop("_items")
