"""Best-fit packing of tokenized documents by minimum bin slack.

Documents become pieces of at most ``size`` tokens. The packing itself is decided on the histogram of piece
lengths, which has at most ``size`` entries however large the corpus is: for each bin a bitset subset-sum
finds the fullest combination of available lengths, and that combination is taken as often as the counts
allow. Every combination uses up at least one length, so the plan is bounded by ``size`` as well. Pieces then
find their place by their rank among the pieces of equal length; ranks come from counts per task and prefix
sums, so a length that a third of the pieces share is still dealt by all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

from .tokens import encoder

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, place long")


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of every document: its ids by ``tokenizer`` followed by ``end_id``.

    A document of at most ``size`` tokens is one piece. A longer one is cut from its end into pieces of ``size``
    tokens, so that only the first may be shorter. NULL text counts as empty, rows with equal ids are separate
    documents, and other columns are ignored. ``part`` and ``place`` number the pieces of one length within a task.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("place", pa.int64()),
    ])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) if len(ids) <= size else len(ids) % size or size
                edges = [0, *range(first, len(ids), size), len(ids)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    raw = ids[a:b].tobytes()
                    rows.append((doc_id, i, a, b - a, zlib.crc32(raw), raw if with_ids else None, part, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``size`` that holds the longest one.

    Subset sums are the bits of one integer. Lengths are added from the longest down, copies in doubling groups,
    until the sum ``size`` is reached.
    """
    lengths = sorted((n for n, c in counts.items() if c > 0), reverse=True)
    seed = lengths[0]
    room = size - seed
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, group = min(counts[length] - (length == seed), room // length), 1
        while left > 0:
            take = min(group, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            group *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], size: int) -> np.ndarray:
    """Rows (length, first rank, copies per bin, first bin, offset in the bin, bins), sorted by length and rank."""
    left, used, entries, bins = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while any(left.values()):
        chosen = fullest(left, size)
        times, offset = min(left[n] // k for n, k in chosen.items()), 0
        for length, copies in chosen.items():
            entries.append((length, used[length], copies, bins, offset, times))
            used[length] += copies * times
            left[length] -= copies * times
            offset += length * copies
        bins += times
        left = {n: c for n, c in left.items() if c}
    return np.array(sorted(entries), np.int64).reshape(-1, 6)


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces``, which must come from a written table.

    Sequences are numbered from 0 and filled from offset 0 without gaps.
    """
    per_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, size)
    # One sorted key per entry; a rank stays far below 2^46.
    keys = (plan[:, 0] << 46) | plan[:, 1]
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("place")).drop("base")
    kept = [f for f in cut.schema.fields if f.name not in ("part", "place")]
    out = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            entry = plan[np.searchsorted(keys, (length << 46) | rank, "right") - 1]
            number = rank - entry[:, 1]
            arrays = [pa.array(entry[:, 3] + number // entry[:, 2]), pa.array(entry[:, 4] + number % entry[:, 2] * length)]
            fields = [batch.schema.field(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *arrays], schema=pa.schema([*fields, *out]))

    columns = ["length", "rank", *[F.col(f.name).alias(f"kept_{f.name}") for f in kept]]
    schema = ", ".join(f"kept_{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    placed = ranked.select(*columns).mapInArrow(place, schema)
    return placed.select(*[F.col(f"kept_{f.name}").alias(f.name) for f in kept], "sequence_id", "offset")


def best_fit(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` with their ids, sequence and offset; an empty table gives no rows."""
    return pack(write_and_reload(pieces(docs, tokenizer, size, end_id, with_ids)), size)
