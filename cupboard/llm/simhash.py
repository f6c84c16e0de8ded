"""Near-duplicates by SimHash: fingerprints, links within a few bits, and groups of linked documents.

Links are searched in an embedding. A fingerprint is cut into segments of two bits, and each segment is replaced
by its number of set bits. The Manhattan distance of two such vectors is a lower bound of the Hamming distance
of the fingerprints, so only vectors within ``max_bits`` can belong to a link. A vector is written in unary
(0, 1, 2 set bits as 00, 01, 11), which makes the Manhattan distance a population count of an exclusive or.
The grid has one cell for every choice of blocks of coordinates: two vectors at most ``max_bits`` apart agree
on all but ``max_bits`` of the blocks, hence meet in the cell of the blocks they share.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cupboard.operators.components import smallest_reachable
from cupboard.session import write_and_reload

SEED = 42
LOW = 0x5555555555555555


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of one text: a bit is set if it is set in over half of the shingle hashes; 0 without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    runs = zip(*(found[i:] for i in range(shingle))) if len(found) >= shingle else [found]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(run), SEED) for run in runs], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, ``text_hash`` and signed ``bits`` of every row. A-Z are lower-cased; words are separated by ASCII blanks.

    A text with fewer words than ``shingle`` hashes as a whole; NULL and blank texts have fingerprint 0.
    """
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits)], names=["doc_id", "text_hash", "bits"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, text_hash long, bits long")


def embedded(bits: np.ndarray) -> np.ndarray:
    """Segment counts in unary: both bits of a segment sorted, the lower one first."""
    high = (bits >> np.uint64(1)) & np.uint64(LOW)
    low = bits & np.uint64(LOW)
    return ((high & low) << np.uint64(1)) | high | low


def blocks_for(n: int, max_bits: int) -> int:
    """Into how many blocks segments are cut for ``n`` fingerprints. Two segments of random bits agree with 3/8, so with more
    blocks there are more cells and fewer strangers in each. A fingerprint costs one row in every cell and one
    comparison with every stranger there; the number of blocks with the least cost, comparisons counted sixteenfold,
    keeps both near constant: a stranger each up to a million fingerprints, some dozens at a hundred billion."""
    least = 2 * max_bits or 1

    def cost(blocks: int) -> float:
        return math.comb(blocks, max_bits) * (1 + 16 * n * 0.375 ** (32 * (blocks - max_bits) / blocks))

    return min(range(least, max(least, 24) + 1), key=cost)


def grid(max_bits: int, blocks: int) -> list[int]:
    """Masks of the cells: all but ``max_bits`` of ``blocks`` equal blocks of segments (at least one block stays)."""
    edges = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - max_bits)]


def _forest(found: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell as a spanning forest: every reached member with the member it was reached from."""
    where, todo = embedded(found), np.ones(len(found), bool)
    near, far = [], []
    for seed in range(len(found)):
        if not todo[seed]:
            continue
        todo[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            rest = np.flatnonzero(todo)
            rest = rest[np.bitwise_count(where[rest] ^ where[at]) <= max_bits]  # Manhattan distance, the bound
            hit = rest[np.bitwise_count(found[rest] ^ found[at]) <= max_bits]  # Hamming distance, exact
            todo[hit] = False
            near.append(np.full(len(hit), found[at]))
            far.append(found[hit])
            front.extend(hit.tolist())
    empty = [np.empty(0, np.uint64)]
    return np.concatenate(near + empty), np.concatenate(far + empty)


def links(distinct: DataFrame, max_bits: int = 3, cell_rows: int = 4096) -> DataFrame:
    """Links (a, b) that connect what fingerprints within ``max_bits`` bits connect, each a true link.

    ``distinct`` holds every value of ``bits`` once. A cell gives a spanning forest of its links, not all pairs.
    Cells of more than ``cell_rows`` members are cut into blocks, and every pair of blocks is compared by a task
    of its own, so no task holds more than ``2 * cell_rows`` members of a cell however many it has. The number of cells
    follows the number of fingerprints (``blocks_for``), and so keeps them small.
    """
    blocks = blocks_for(distinct.count(), max_bits)
    masks = [m - (1 << 64) if m >> 63 else m for m in grid(max_bits, blocks)]
    spread = F.shiftrightunsigned("bits", 1).bitwiseAND(F.lit(LOW))
    low = F.col("bits").bitwiseAND(F.lit(LOW))
    unary = F.shiftleft(spread.bitwiseAND(low), 1).bitwiseOR(spread).bitwiseOR(low)
    cells = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("unary").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    members = distinct.withColumn("unary", unary).select("bits", F.inline(cells))
    sizes = members.groupBy("mask", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = members.join(write_and_reload(sizes), ["mask", "cell"])
    # Block pairs (i, j): a member of block k takes part in (k, j) and (i, k); the pair of one block with itself once.
    n_blocks = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("bits"), n_blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda other: F.struct(
        F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    dealt = shared.select("mask", "cell", "bits", F.inline(pairs))
    placed = dealt.repartition("mask", "cell", "i", "j").sortWithinPartitions("mask", "cell", "i", "j", "bits")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
            rows = rows if held is None else np.concatenate([held, rows])
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            yield of(np.split(rows[:cuts[-1]], cuts[:-1]) if len(cuts) else [])
            held = rows[cuts[-1]:] if len(cuts) else rows
        if held is not None:
            yield of([held])

    def of(groups: list[np.ndarray]) -> pa.RecordBatch:
        found = [_forest(g[:, 4].astype(np.uint64), max_bits) for g in groups]
        a, b = (np.concatenate([np.empty(0, np.uint64), *side]).view(np.int64) for side in (zip(*found) if found else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return placed.select("mask", "cell", "i", "j", "bits").mapInArrow(joined, "a long, b long")


def _named(smallest: DataFrame, max_bits: int) -> DataFrame:
    """(bits, least, root): the rows of ``smallest`` (every value of ``bits`` once) with the root of their group."""
    roots = smallest_reachable(links(smallest.select("bits"), max_bits))
    return smallest.join(roots, smallest.bits == roots.node, "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, ``fingerprint`` (16 lowercase hexadecimal digits) and ``component_id`` of every row of ``docs``.

    The component is named by the smallest doc_id that links lead to; a NULL id counts only if there is no other.
    Rows with equal fingerprints, copies included, take part in the search as one. Empty tables give no rows.
    """
    hashed = write_and_reload(fingerprints(docs, shingle).select("doc_id", "bits"))
    smallest = write_and_reload(hashed.groupBy("bits").agg(F.min("doc_id").alias("least")))
    named = write_and_reload(_named(smallest, max_bits))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_bits = write_and_reload(named.join(groups, "root").select("bits", "component_id"))
    return hashed.join(of_bits, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _firsts(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """(__id, __hash, __n) of each group: its smallest (doc_id, text hash), NULL ids last, and the rows that have both."""
    hashed = write_and_reload(fingerprints(docs, shingle))
    counted = hashed.groupBy("bits", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")
    smallest = write_and_reload(counted.groupBy("bits").agg(F.min(order).alias("least")))
    firsts = _named(smallest, max_bits).groupBy("root").agg(F.min("least").alias("least"))
    return write_and_reload(firsts.select(
        F.col("least.doc_id").alias("__id"), F.col("least.text_hash").alias("__hash"), F.col("least.n").alias("__n")))


def _rows_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row of ``firsts``."""
    shared = write_and_reload(firsts.where("__n > 1").drop("__n"))  # normally empty, so its join costs no shuffle
    rank = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("text")

    def named_in(chosen: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(chosen["__id"]) & (F.xxhash64(docs["text"]) == chosen["__hash"])
        return docs.join(chosen, same, "left_semi")

    repeated = named_in(shared).withColumn("__nth", F.row_number().over(rank))
    # The kept rows grow with the corpus: a sort-merge join at every size.
    return named_in(firsts.where("__n = 1").hint("merge")).unionByName(repeated.where("__nth = 1").drop("__nth"))


def first_of_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Exactly one row of each group: the one with the smallest (doc_id, text hash). All columns are returned unchanged.

    Ids only choose inside a group, so repeated and NULL ids lose no group. A NULL id stays only in a group without
    another id.
    """
    return _rows_of(docs, _firsts(docs, shingle, max_bits))


def keep_first(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``first_of_groups`` for tables in which an id stands for one document, whatever texts it has.

    Of several groups whose first rows share an id, the one with the smallest text hash stays. Rows without an id
    are documents of their own.
    """
    firsts = _firsts(docs, shingle, max_bits)
    named = firsts.where("__id is not null").groupBy("__id").agg(F.min(F.struct("__hash", "__n")).alias("least"))
    return _rows_of(docs, write_and_reload(
        firsts.where("__id is null").unionByName(named.select("__id", "least.*"))))
