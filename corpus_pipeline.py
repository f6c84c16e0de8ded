"""Documents to packed training sequences: the stages in order, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cupboard.llm import decontaminate, language, packing, pii, simhash
from cupboard.llm.common import read
from cupboard.llm.queries import SURROGATE_KEY, vocabulary
from cupboard.session import write_and_reload


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, and those whose winning machines disagree, go."""
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.5)
    return language.identify(docs, model).where(known).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: three-word shingles, at most three differing bits."""
    return simhash.first_of_groups(docs, shingle=3, max_bits=3)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles go."""
    return decontaminate.without_items(docs, read(spark, sf_dir, "benchmark"), 5, 0.8)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced; every document stays."""
    return pii.replaced(docs, SURROGATE_KEY).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    pieces = packing.best_fit(docs, vocabulary(), size=2048, end_id=0, with_ids=False)
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identified), ("simhash_near_dedup", one_of_each_group), ("decontamination", decontaminated),
    ("pii_surrogates", with_surrogates), ("best_fit_packing", packed),
]

ORACLE_SQL = None  # trained machines, SimHash groups and packing have no SQL; tests hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_and_reload(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
