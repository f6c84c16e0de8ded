"""Benchmark decontamination: which documents contain which test items, in built-in functions only.

Containment is the share of an item's distinct word shingles that a document holds. The search is a MinHash search
made for sets of very different sizes. Items are partitioned by their number of shingles, and a partition keeps as
many of an item's smallest shingle hashes as its size needs: an item of n shingles with at least ``threshold`` of
them in a document shares one of its ``n - ceil(threshold * n) + 1`` smallest, so no item is missed whatever the
length of the document. Documents are partitioned by size too and look only at items that fit into them. Candidates
are then checked on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

from .common import small_side

# Sketch rows (16 bytes each) that may be broadcast; larger benchmarks are joined by a shuffle.
BROADCAST_ROWS = 200_000
# Benchmark text whose shingles may be broadcast for the exact check (five to six times as many bytes).
BROADCAST_BYTES = 4 << 20


def normal_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def shingle_hashes(word_hashes: Column, n: int) -> Column:
    """One hash per run of ``n`` words, from an array column with one hash per word; fewer words have none."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(word_hashes) - n), lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(n)]))
    return F.when(F.size(word_hashes) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def _hashed(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """The key columns and ``hashes``; each step is a column of its own, so that none is computed twice."""
    words = rows.select(*key, F.transform(normal_words(F.col("text")), lambda w: F.xxhash64(w)).alias("word_hashes"))
    return words.select(*key, shingle_hashes(F.col("word_hashes"), n).alias("hashes"))


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of ``n`` words as texts."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def item_sketches(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(hash, item_key, need, size_class): the smallest hashes of every item, as many as its size class needs.

    ``need`` is the least number of shared shingles; ``size_class`` the binary logarithm of ``need``.
    """
    hashes = F.array_sort(F.array_distinct("hashes"))
    need = F.ceil(F.lit(threshold) * F.size("hashes") - F.lit(1e-9)).cast("int")
    return (
        _hashed(items, ["item_key"], n).select("item_key", hashes.alias("hashes"))
        .where(F.size("hashes") > 0).withColumn("need", need)
        .withColumn("size_class", F.floor(F.log2("need")).cast("int"))
        .withColumn("kept", F.slice("hashes", F.lit(1), F.size("hashes") - F.col("need") + 1))
        .select(F.explode("kept").alias("hash"), "item_key", "need", "size_class").distinct()
    )


def candidates(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, text_hash, item_key) that share a sketch hash, sizes permitting."""
    sketch = small_side(write_and_reload(item_sketches(items, n, threshold)), BROADCAST_ROWS)
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    sized = _hashed(keyed, ["doc_id", "text_hash"], n).withColumn(
        "doc_class", F.coalesce(F.floor(F.log2(F.size("hashes"))).cast("int"), F.lit(-1)))
    # The outer form: for the inner one Spark adds a filter that would compute the hashes once more.
    probes = sized.select("doc_id", "text_hash", "doc_class", F.explode_outer("hashes").alias("hash"))
    met = probes.join(sketch, "hash").where("size_class <= doc_class")
    return met.select("doc_id", "text_hash", "item_key").distinct()


def _pairs(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_shared, containment) of the pairs of texts with enough containment.

    Items are told apart by a hash of id and text, so items with a repeated or NULL id are all searched.
    """
    docs = docs.select("doc_id", "text")
    items = items.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text")
    found = write_and_reload(candidates(docs, items, n, threshold))
    wanted = items.select("item_key", "item_id", normal_words(F.col("text")).alias("words")).select(
        "item_key", "item_id", shingles(F.col("words"), n).alias("item_shingles"))
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    hits = found.groupBy("doc_id", "text_hash").agg(F.collect_set("item_key").alias("item_keys"))  # at most all items
    hits = write_and_reload(hits)
    checked = (
        texts.join(hits, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
        .select("doc_id", "text_hash", "item_keys", normal_words(F.col("text")).alias("words"))
        .select("doc_id", "text_hash", "item_keys", shingles(F.col("words"), n).alias("doc_shingles"))
        .select("doc_id", "text_hash", "doc_shingles", F.explode("item_keys").alias("item_key"))
        .join(wanted, "item_key")
        .select("doc_id", "text_hash", "item_id", F.size("item_shingles").cast("long").alias("n_shingles"),
                F.size(F.array_intersect("item_shingles", "doc_shingles")).cast("long").alias("n_shared"))
    )
    return checked.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold - 1e-9)


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of all pairs with containment of ``threshold`` or more.

    NULL texts, texts of fewer than ``n`` words and empty tables contribute nothing; equal rows count once; rows that
    share an id but not a text are judged apart and the larger containment is returned, documents and items alike;
    NULL is an id as any other; other columns are ignored.
    """
    pairs = _pairs(docs, items, n, threshold)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment")


def without_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose text contains an item, whatever ids they share; the rows kept are unchanged."""
    pairs = _pairs(docs, items, n, threshold)
    hit = write_and_reload(pairs.select(F.col("doc_id").alias("__hit"), F.col("text_hash").alias("__hash")).distinct())
    same = docs["doc_id"].eqNullSafe(hit["__hit"]) & (F.xxhash64(docs["text"]) == hit["__hash"])
    return docs.join(hit, same, "left_anti")
