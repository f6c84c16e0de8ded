"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every distinct shingle hash below a fixed fraction of the hash range. Sketches of any two documents,
however unequal, therefore sample the same shingles: the share of the smaller sketch that the larger one holds
estimates its containment, and the union of sketches is the sketch of the texts together. Where no hash is below the
threshold, the smallest one stands for the text, so that only texts without words have an empty sketch.

A word's hash is the first 15 hexadecimal digits of its MD5; a shingle's is the sum of its words' hashes times odd
numbers, modulo 2^64.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, PARTS = 5, 4
_KNOWN_WORDS = 200_000


def factors(shingle: int) -> list[int]:
    """The odd 63-bit numbers the hashes of a shingle's words are multiplied by."""
    return [int(hashlib.md5(f"factor {i}".encode()).hexdigest()[:16], 16) >> 1 | 1 for i in range(shingle)]


class Sketcher:
    """Sketches of texts as sorted hashes: those below ``2^64 / parts``, or the smallest if there is none."""

    def __init__(self, shingle: int = SHINGLE, parts: int = PARTS):
        self.shingle, self.limit = shingle, np.uint64((1 << 64) // parts)
        self.factors = np.array(factors(shingle), np.uint64)
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self.known) >= _KNOWN_WORDS:
            self.known.clear()
        return self.known.setdefault(word, int(hashlib.md5(word).hexdigest()[:15], 16))

    def sketch(self, text: str) -> np.ndarray:
        """A-Z are lower-cased, words are separated by ASCII blanks; a text of fewer words is one shingle."""
        found, known = text.encode().lower().split(), self.known
        if not found:
            return np.zeros(0, np.uint64)
        w = np.array([known[x] if x in known else self._word(x) for x in found], np.uint64)
        size = min(self.shingle, len(w))
        total = np.zeros(len(w) - size + 1, np.uint64)
        for i in range(size):
            total += w[i:len(w) - size + 1 + i] * self.factors[i]
        below = total[total < self.limit]
        return np.unique(below) if len(below) else total.min(keepdims=True)


def written(sketch: np.ndarray) -> str:
    """16 hexadecimal digits a hash, rising."""
    return sketch.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller document in the larger; two empty sketches are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def hashes(fingerprint: Column) -> Column:
    """The hashes of a written fingerprint as an array of texts of 16 digits."""
    last = (F.length(fingerprint) / 16).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: fingerprint.substr(i * 16 + 1, F.lit(16)))


def sketch_rows(fingerprints: DataFrame, *keys: str) -> DataFrame:
    """(keys, hash): a row for each hash of the column ``fingerprint``."""
    some = fingerprints.where(F.length("fingerprint") > 0)
    return some.select(*keys, F.explode(hashes(F.col("fingerprint"))).alias("hash"))


def merged(rows: DataFrame, *keys: str, parts: int = PARTS) -> DataFrame:
    """(keys, hash): the sketch of all texts that share the keys, from their sketches; as rows, so it may be large."""
    limit = f"{(1 << 64) // parts:016x}"
    distinct = rows.select(*keys, "hash").distinct()
    least = distinct.groupBy(*keys).agg(F.min("hash").alias("_least")).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return distinct.join(least, same).where((F.col("hash") < limit) | (F.col("hash") == F.col("_least"))).select(*keys, "hash")


def contained(rows: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, the groups' columns, n_hashes, n_shared, containment) of documents in merged sketches that share a hash.

    ``rows`` has (key, hash), ``groups`` its own columns and hash. A hash gives a row for each group that has it, so the
    groups should be few (sources, shards, a reference set), while each may be of any size.
    """
    names = [c for c in groups.columns if c != "hash"]
    sizes = rows.groupBy(key).agg(F.count("*").alias("n_hashes")).withColumnRenamed(key, "_key")
    shared = rows.join(groups, "hash").groupBy(key, *names).agg(F.count("*").alias("n_shared"))
    joined = shared.join(sizes, shared[key].eqNullSafe(sizes["_key"])).drop("_key")
    return joined.select(key, *names, "n_hashes", "n_shared", (F.col("n_shared") / F.col("n_hashes")).alias("containment"))


DEALT = "bucket int, tail boolean, doc_id long, text_hash long, times long, text string"


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows dealt to buckets by (doc_id, text hash), in order inside a bucket (DEALT).

    The texts are shuffled once. Each bucket ends with a copy of the first row of the next one (``tail``; after the
    last bucket the first), so that every row's successor is in its own task. The ranges come from the keys alone,
    cut by Spark's range partitioning, so a hot or NULL id is cut too; equal rows of a batch travel as one with ``times``.
    """
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    key = F.struct("doc_id", "text_hash")
    ranged = rows.select("doc_id", "text_hash").repartitionByRange(n, "doc_id", "text_hash")
    firsts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("first")).collect()  # n rows at most
    cuts = sorted((r["first"]["doc_id"] is not None, r["first"]["doc_id"] or 0, r["first"]["text_hash"]) for r in firsts)
    before = {cut: (i or len(cuts)) - 1 for i, cut in enumerate(cuts)}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            first: dict[tuple, int] = {}  # key to its place in ``at``
            at, times = [], []
            for i, key in enumerate(keys):
                place = first.setdefault(key, len(at))
                if place < len(at) and batch.column(2)[at[place]] == batch.column(2)[i]:
                    times[place] += 1
                else:
                    at.append(i)
                    times.append(1)
            ranks = [(keys[i][0] is not None, keys[i][0] or 0, keys[i][1]) for i in at]
            to = [max(0, bisect_right(cuts, r) - 1) for r in ranks]
            tails = [(i, before[r]) for i, r in zip(at, ranks) if r in before]
            where = pa.array(at + [i for i, _ in tails], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(to + [b for _, b in tails], pa.int32()), pa.array([False] * len(at) + [True] * len(tails)),
                 batch.column(0).take(where), batch.column(1).take(where), pa.array(times + [1] * len(tails), pa.int64()), batch.column(2).take(where)],
                names=["bucket", "tail", "doc_id", "text_hash", "times", "text"])

    dealt = rows.mapInArrow(deal, DEALT).repartitionById(n, "bucket")
    return dealt.sortWithinPartitions("bucket", "tail", "doc_id", "text_hash", "text")


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprints_of_edits(docs: DataFrame, shingle: int = SHINGLE, parts: int = PARTS, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half is the beginning of the next document's.

    The last ``floor(n_chars / 2)`` code points are replaced by as many of the next document (all, if it has fewer),
    in the order of doc_id, NULL ids first, equal ids by a hash of the text, after the last the first. ``near_edited`` and
    ``near_next`` compare the fingerprint with the edited text's and the next document's. A NULL text is empty; an
    empty sketch is an empty string; repeated rows are rows; no rows give none; other columns are ignored. Two rows
    and the batch they came with are held at a time, whole texts.
    """
    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(shingle, parts)
        bucket, held = None, None  # the row before: doc_id, text, sketch, times
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(i) for i in (0, 1, 2, 4, 5))
            for b, tail, doc_id, times, text in zip(*(c.to_pylist() for c in columns)):
                if b != bucket:
                    bucket, held = b, None
                elif held is None:  # further copies of the tail
                    continue
                sketch = sketcher.sketch(text)
                if held is not None:
                    out += row(sketcher, held, text, sketch, 1)
                held = None if tail else (doc_id, text, sketch, times)
                if held and times > 1:
                    out += row(sketcher, held, text, sketch, times - 1)
            yield table(out)

    def row(sketcher: Sketcher, held: tuple, following: str, sketch: np.ndarray, times: int) -> list[tuple]:
        doc_id, text, own, _ = held
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        changed = sketcher.sketch(edited)
        return [(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(changed),
                 likeness(own, changed), likeness(own, sketch))] * times

    def table(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*out)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in RESULT.split(", ")])

    return in_order(docs, buckets).mapInArrow(pairs, RESULT)
