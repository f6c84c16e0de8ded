"""Suffix-array deduplication: every byte inside a string of ``depth`` bytes that occurs twice in the corpus goes.

The suffixes of all documents are sorted by most significant digits, only as deep as ``depth`` bytes, and groups of
one drop out after each pass; groups that are left are exactly the repeated strings. Neighbouring suffixes travel
together as runs, each named by an anchor: the gram of 32 bytes with the smallest hash in a suffix, which is the
same gram at the same distance in every equal suffix.

1. First digit, the gram: counted over the corpus. A gram that one run has takes all its suffixes out.
2. Second digit, the bytes of a whole run: equal runs repeat with all their suffixes. One run of each kind stays in
   the sort for grams that also have a run of which there is only one.
3. Remaining digits: the suffixes of what is left, gram by gram, 40 bytes at a time (``suffixes.repeated_suffixes``).

Digits are compared by 64-bit hashes of their bytes, whole runs by a hash of the whole: strings count as equal if all
these agree, which two different ones do with a chance of 2^-64 for each pair that is compared.

A gram with a third of all documents is counted with partial sums, joined with skew splitting, and enters the third
pass with its distinct runs only; a gram with more of them than ``bucket_rows`` is sorted by single suffixes, which
any number of tasks can share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

from .suffixes import GRAM, Hashes, repeated_suffixes, runs_of, within_text

# Bits of the filter that spares the shuffle runs whose gram is alone; at most 16 MB however large the corpus is.
FILTER_BITS = 1 << 27
RUNS = "id_hash long, text_hash long, place long, gram long, whole long, twice boolean"
KEY = ("id_hash", "text_hash")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of two 64-bit numbers: one of id, length and CRC-32, one of the text alone. Rows that share an
    id or have none are told apart by both; rows equal in id and text share their key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    id_hash = F.xxhash64(doc_id.isNull(), doc_id, F.octet_length(text), F.crc32(F.encode(text, "UTF-8")))
    return docs.select(doc_id.alias("doc_id"), id_hash.alias("id_hash"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _slots(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return gram & mask, (gram >> np.uint64(32)) & mask


def _gram_filter(grams: DataFrame, n: int) -> np.ndarray:
    """Bloom filter with two bits for each of ``n`` grams; its 64-bit words are put together by aggregation."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(12, (12 * n).bit_length()))
    both = F.array(F.col("gram").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(bits - 1)))
    words = (
        grams.select(F.explode(both).alias("slot"))
        .select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    table = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def _runs(rows: DataFrame, depth: int, wanted=None) -> DataFrame:
    """Runs of all texts, equal runs of one text once; ``wanted`` is a broadcast gram filter."""
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = runs_of(_bytes(batch.column(2)), depth)
            first, twice = within_text(runs)
            if wanted is not None:
                words = wanted.value
                for slot in _slots(runs.gram, 64 * len(words)):
                    first &= (words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            at = np.flatnonzero(first)
            of = pa.array(runs.piece[at])
            place = runs.anchor[at] << 16 | runs.low[at] << 8 | runs.high[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(place), _signed(runs.gram[at]),
                 _signed(runs.whole[at]), pa.array(twice[at])],
                names=["id_hash", "text_hash", "place", "gram", "whole", "twice"])

    return rows.select(*KEY, "text").mapInArrow(scan, RUNS)


def _spans_of_runs(runs: DataFrame, depth: int) -> DataFrame:
    """The bytes that all suffixes of a run cover."""
    anchor = F.shiftright("place", 16)
    low, high = F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))
    return runs.select(*KEY, (anchor - high).alias("begin"), (anchor - low + depth).alias("end"))


def _segments(rows: DataFrame, chosen: DataFrame, depth: int) -> DataFrame:
    """Bytes of the chosen runs (id_hash, text_hash, place, gram, wide); a wide run gives a row per suffix instead,
    with the hash of the whole suffix as its gram."""
    lists = chosen.groupBy(*KEY).agg(F.collect_list(F.struct("place", "gram", "wide")).alias("runs"))
    names = ["id_hash", "text_hash", "place", "gram", "wide", "bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_hash, text_hash, raw, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2)), batch.column(3).to_pylist()):
                for run in runs:
                    anchor, low, high = run["place"] >> 16, run["place"] >> 8 & 255, run["place"] & 255
                    segment = raw[anchor - high:anchor - low + depth]
                    if not run["wide"]:
                        out.append((id_hash, text_hash, run["place"], run["gram"], False, segment))
                        continue
                    starts = np.arange(high - low + 1)
                    keys = Hashes(np.frombuffer(segment, np.uint8)).of(starts, depth).view(np.int64)
                    out += [(id_hash, text_hash, anchor << 16 | d << 8 | d, int(key), True, None) for key, d in zip(keys, range(high, low - 1, -1))]
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    joined = rows.join(lists, list(KEY)).select(*KEY, "text", "runs")
    return joined.mapInArrow(cut, "id_hash long, text_hash long, place long, gram long, wide boolean, bytes binary")


def _spans_in_buckets(segments: DataFrame, depth: int) -> DataFrame:
    """Spans of the repeated suffixes among segments of equal gram. Equal rows bring equal segments, which enter once."""
    order = ("gram", *KEY, "place")
    dealt = segments.select(*order, "bytes").repartition("gram").sortWithinPartitions(*order)

    def sort(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            new = np.append(last is None or (names[0] != last).any(), (names[1:] != names[:-1]).any(axis=1))
            last = names[-1]
            table = pa.Table.from_batches([batch]).filter(pa.array(new))
            table = pa.concat_tables([held, table]) if held is not None else table
            gram = table["gram"].to_numpy()
            edge = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0  # the last bucket may go on
            yield of(table.slice(0, edge))
            held = table.slice(edge)
        if held is not None:
            yield of(held)

    def of(table: pa.Table) -> pa.RecordBatch:
        place = table["place"].to_numpy().astype(np.int64)
        row, begin, end = repeated_suffixes(
            table["gram"].to_numpy(), place >> 16, place >> 8 & 255, place & 255, table["bytes"].to_pylist(), depth)
        table = table.combine_chunks().take(pa.array(row))
        columns = [table["id_hash"].combine_chunks(), table["text_hash"].combine_chunks(), pa.array(begin, pa.int64()), pa.array(end, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["id_hash", "text_hash", "begin", "end"])

    return dealt.mapInArrow(sort, "id_hash long, text_hash long, begin long, end long")


def repeated_spans(rows: DataFrame, depth: int, bucket_rows: int = 20_000) -> DataFrame:
    """(id_hash, text_hash, begin, end): spans of strings that another text holds too.

    What repeats within one text only is left to ``_removed``, which has the text.
    """
    grams = _runs(rows, depth).groupBy("gram").agg(F.count("*").alias("n"), (F.min("whole") == F.max("whole")).alias("uniform"))
    grams = write_and_reload(grams.where("n > 1").select("gram", "uniform"))
    wanted = rows.sparkSession.sparkContext.broadcast(_gram_filter(grams, grams.count()))
    shared = write_and_reload(_runs(rows, depth, wanted).join(grams, "gram"))

    kinds = shared.where("not uniform").groupBy("gram", "whole").agg(
        F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"), F.min(F.struct(*KEY, "place")).alias("one"))
    kinds = write_and_reload(kinds)
    whole = shared.where("uniform").select(*KEY, "place").unionByName(
        shared.where("not uniform").join(kinds.where("n > 1").select("gram", "whole"), ["gram", "whole"]).select(*KEY, "place"))
    per_gram = write_and_reload(kinds.groupBy("gram").agg(F.min("n").alias("least"), (F.count("*") > bucket_rows).alias("wide")))
    chosen = kinds.join(per_gram.where("least = 1").select("gram", "wide"), "gram").select("one.*", "gram", "wide")

    segments = write_and_reload(_segments(rows, chosen, depth))
    suffixes = segments.where("wide")
    often = write_and_reload(suffixes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    single = _spans_of_runs(suffixes.join(often, "gram"), depth)
    return _spans_of_runs(whole, depth).unionByName(_spans_in_buckets(segments.where("not wide"), depth)).unionByName(single)


def _removed(rows: DataFrame, spans: DataFrame, depth: int, with_kept: bool) -> DataFrame:
    # A set: equal rows find the same spans, so a list is as long as its text's different ones.
    lists = spans.groupBy(*KEY).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = rows.join(lists, list(KEY), "left").select("doc_id", "text", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(1))
            runs = runs_of(texts, depth)
            _, twice = within_text(runs)
            own = np.flatnonzero(twice)
            own = own[np.argsort(runs.piece[own], kind="stable")]
            cuts = np.searchsorted(runs.piece[own], np.arange(len(texts) + 1))
            begins, ends = runs.anchor - runs.high, runs.anchor - runs.low + depth
            out = []
            for i, (doc_id, raw) in enumerate(zip(batch.column(0).to_pylist(), texts)):
                mine = own[cuts[i]:cuts[i + 1]]
                change = np.zeros(len(raw) + 1, np.int64)
                for at, step in ((begins[mine], 1), (ends[mine], -1), (batch.column(2)[i].as_py() or [], 1), (batch.column(3)[i].as_py() or [], -1)):
                    np.add.at(change, np.asarray(at, np.int64), step)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
                n_spans = int((gone[1:] & ~gone[:-1]).sum()) + bool(len(gone) and gone[0])
                out.append((doc_id, len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, depth: int = 200, bucket_rows: int = 20_000, with_kept: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes that stay (NULL if
    not asked for).

    A byte goes if a string of ``depth`` bytes over it also starts elsewhere, in the same document or another; strings
    never cross documents and are judged on the input, so all copies go. NULL text counts as empty; shorter texts
    than ``depth`` stay whole; equal rows are copies of each other; other columns are ignored; ``kept`` may end
    inside a character. ``depth`` must be above the gram by at most 255 bytes.
    """
    if not GRAM < depth <= GRAM + 255:
        raise ValueError(f"depth must be above {GRAM} and at most {GRAM + 255}")
    rows = _identified(docs)
    return _removed(rows, repeated_spans(rows, depth, bucket_rows), depth, with_kept)
