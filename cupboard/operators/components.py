"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cupboard.session import write_and_reload


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root being its component's smallest node.

    A large-star step links the greater neighbours of a node to the smallest of its neighbourhood, a small-star
    step does so with the others; the links become stars after a logarithmic number of rounds. Every round is
    written, so a lost executor repeats one round at most. A node of very many links is only ever aggregated
    (its minimum, combined before the shuffle) and joined.
    """
    edges = write_and_reload(_clean(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = None
    while True:
        edges = write_and_reload(_small_star(_large_star(edges)))
        # Stars have one link per node to its root: no step changes them.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _clean(edges: DataFrame) -> DataFrame:
    """Links from the greater to the smaller end, each once."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _clean(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _clean(moved.unionByName(least.select("u", F.col("m").alias("v"))))
