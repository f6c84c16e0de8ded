"""Hard-negative mining: for an anchor and each of its positives, the best rows of other labels inside a score window.

Candidates are dealt to cells around centres chosen farthest first from a bounded sample, every row is assigned, and
the cells' exact covering radii make a cover tree over cells. Large cells are cut into blocks. An anchor is sent to the
blocks its bounds allow, and each block answers from a cover tree of its own (``covertree``), so a result is exact
whatever the sample was. Best rows of a block are merged with those of others.

Of rows with equal label and vector only those with the smallest ids can be among the first k, so a vector that a third
of all rows have brings k rows into the search; anchors are taken from all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

from .covertree import Block, CoverTree, SLACK, augmented, distances, farthest_first
from .vectors import matrix, of_usual_length, scaled, usable

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_NO_ID = MOST  # a NULL id counts as the largest
# Numbers of the vectors a block holds, and of the sample, at most: wide vectors come in smaller blocks.
BLOCK_NUMBERS, SAMPLE_NUMBERS = 1 << 22, 1 << 20

QUERY = "anchor long, id long, label long, x array<long>, low array<long>, high array<long>"
_SENT = "block long, kind int, anchor long, id long, label long, x array<long>, low array<long>, high array<long>, floors array<long>"


class Index:
    """Cells of the candidates: a tree over their centres, blocks, and a broadcast sample for first thresholds."""

    def __init__(self, rows: DataFrame, d: int, n: int, sample_rows: int, cell_rows: int, block_rows: int):
        self.d = d
        norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        self.square = float(rows.agg(F.max(norm)).first()[0] or 0.0) * (1 + 1e-12)
        sample = rows.orderBy(F.xxhash64("x", "label", "id"), "id", "label").limit(sample_rows).select("id", "label", "x").toArrow()
        ids, labels = (sample.column(i).to_numpy() for i in (0, 1))
        x = matrix(sample.column(2).combine_chunks(), d)
        most = min(1024, max(12, -(-n // cell_rows)), len(x))
        chosen, _, _ = farthest_first(augmented(x, self.square), most)
        centres = augmented(x, self.square)[chosen]
        placed = self._assigned(rows, centres)
        self.placed = write_and_reload(placed)
        cells = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # 1,024 rows at most
        cells.sort()
        numbers, starts = [r["cell"] for r in cells], np.cumsum([0, *(-(-r["n"] // block_rows) for r in cells)])
        tree = CoverTree.above(centres[numbers], np.array([r["far"] for r in cells]))
        blocks = [[range(starts[c], starts[c + 1]) for c in leaf] for leaf in tree.leaves]
        self.n_blocks = int(starts[-1])
        self.cells = rows.sparkSession.createDataFrame(
            [(c, int(a), int(b - a)) for c, a, b in zip(numbers, starts, starts[1:])], "cell int, first long, blocks int")
        context = rows.sparkSession.sparkContext
        # Bounded by sample_rows and 1,024 cells.
        self.shared = context.broadcast((Block.of(ids, labels, x, self.square), tree, [[b for r in leaf for b in r] for leaf in blocks]))

    def _assigned(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """Each row's nearest centre and the distance to it."""
        d, square, lengths = self.d, self.square, (centres ** 2).sum(axis=1)

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = augmented(matrix(batch.column(2), d), square)
                cell = (lengths - 2 * (points @ centres.T)).argmin(axis=1)
                far = distances(points, centres[cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)],
                                                 names=["id", "label", "x", "cell", "far"])

        return rows.select("id", "label", "x").mapInArrow(assign, "id long, label long, x array<long>, cell int, far double")

    def search(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """(anchor, window, score, id): the k best rows of each window of the queries (QUERY), from all blocks."""
        per_block = self._in_blocks(queries, k, same_label)
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        ranked = per_block.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("anchor", "window", "rank", "score", "id")

    def _in_blocks(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        d, square, shared = self.d, self.square, self.shared

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sample, tree, blocks = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    ids, labels, x, low, high = _query(batch, 1, d)
                    _, floors = sample.search(ids, labels, x, low, high, k, same_label, low)
                    wanted, _ = tree.descend(x, floors, high, SLACK * np.sqrt(square))
                    i, leaf = np.nonzero(wanted)
                    counts = np.array([len(b) for b in blocks])[leaf]
                    to = [b for one in leaf for b in blocks[one]]
                    where = pa.array(np.repeat(i, counts))
                    floor_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(floors) + 1, dtype=np.int32) * floors.shape[1]), pa.array(floors.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int64()), pa.array(np.ones(len(to), np.int32)), *(c.take(where) for c in [*batch.columns, floor_lists])],
                        names=[c.split()[0] for c in _SENT.split(", ")])

        block = F.col("first") + F.pmod(F.xxhash64("id", "x"), F.col("blocks"))
        none = F.lit(None).cast("array<long>")
        placed = self.placed.join(F.broadcast(self.cells), "cell")
        held = placed.select(block.alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("anchor"), "id", "label", "x",
                                  none.alias("low"), none.alias("high"), none.alias("floors"))
        both = held.unionByName(queries.select("anchor", "id", "label", "x", "low", "high").mapInArrow(send, _SENT))
        n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(n, min(self.n_blocks, 10_000))
        dealt = both.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "kind")

        def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, held, block = None, [], None
            for batch in batches:
                keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    part = batch.slice(a, b - a)
                    if not part.num_rows:
                        continue
                    if keys[a, 0] != number:
                        number, held, block = keys[a, 0], [], None
                    if keys[a, 1] == 0:
                        held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), matrix(part.column(5), d)))
                        continue
                    if block is None:
                        block = Block.of(*(np.concatenate(c) for c in zip(*held)), square)
                        held = []
                    for at in range(0, part.num_rows, 256):
                        some = part.slice(at, 256)
                        ids, labels, x, low, high = _query(some, 3, d)
                        found, _ = block.search(ids, labels, x, low, high, k, same_label, _lists(some.column(8)))
                        yield pa.RecordBatch.from_arrays(
                            [some.column(2).take(pa.array(found.query)), pa.array(found.window), pa.array(found.score), pa.array(found.id)],
                            names=["anchor", "window", "score", "id"])

        return dealt.mapInArrow(answer, "anchor long, window long, score long, id long")


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _query(batch: pa.RecordBatch, at: int, d: int) -> tuple[np.ndarray, ...]:
    return (batch.column(at).to_numpy(), batch.column(at + 1).to_numpy(), matrix(batch.column(at + 2), d),
            _lists(batch.column(at + 3)), _lists(batch.column(at + 4)))


def mined(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
          scale: int = 256, sample_rows: int = 16_384, cell_rows: int = 4_096, block_rows: int = 65_536) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (RESULT).

    ``embeddings`` has vec_id, label and embedding; ``anchor`` tells the anchors by these columns. Scores are inner
    products of ``floor(scale * c)``; higher ones come first, ties by smaller id. The positives of an anchor are its first
    rows of the same label, itself left out; its negatives for a positive are the first rows of other labels with
    ``low * positive_score <= 100 * score <= high * positive_score``. Fewer are returned where there are fewer.

    Rows with a NULL label or vector, an entry that is NULL or not finite, an empty vector, or another length than most
    distinct rows have, take no part. Rows equal in id, label and vector are one row; a NULL id counts as the largest.
    Empty tables give no rows; other columns are ignored. A task holds a block of at most about ``block_rows`` vectors and
    ``BLOCK_NUMBERS`` numbers, whatever the length of the vectors; the broadcast sample is bounded likewise.
    """
    spark = embeddings.sparkSession
    whole = embeddings.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    rows = whole.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("label").cast("long").alias("label"),
        scaled(F.col("embedding"), scale).alias("x"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows = write_and_reload(rows.groupBy("id", "label", "x").agg(F.max("is_anchor").alias("is_anchor")))
    rows, d = of_usual_length(rows)
    anchors = write_and_reload(rows.where("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "x"))
    if not d or not anchors.head(1):
        return spark.createDataFrame([], RESULT)
    first = F.row_number().over(Window.partitionBy("label", "x").orderBy("id"))
    useful = write_and_reload(rows.select("id", "label", "x", first.alias("nth")).where(F.col("nth") <= max(positives + 1, negatives)).drop("nth"))
    sample_rows, block_rows = max(1, min(sample_rows, SAMPLE_NUMBERS // d)), max(1, min(block_rows, BLOCK_NUMBERS // d))
    index = Index(useful, d, useful.count(), sample_rows, min(cell_rows, block_rows), block_rows)

    anywhere = anchors.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    best = write_and_reload(index.search(anywhere, positives, True))
    # Bounds of the windows in whole scores: rounded up and down; a negative positive score leaves none.
    score = F.col("score").cast("decimal(20,0)")
    least, most = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    listed = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("id").alias("positive"), "score", F.when(least <= most, least).alias("low"), F.when(least <= most, most).alias("high")))).alias("p"))  # at most ``positives`` each

    def filled(part: str, otherwise: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("p", i)[part], F.lit(otherwise)))

    wanted = anchors.join(listed, "anchor").select("anchor", "id", "label", "x", filled("low", MOST).alias("low"), filled("high", LEAST).alias("high"))
    hits = index.search(write_and_reload(wanted), negatives, False).withColumnsRenamed({"score": "negative_score", "id": "negative_id"})
    pairs = best.select("anchor", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = hits.join(pairs, ["anchor", "window"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    shown = {c: F.nullif(F.col(c), F.lit(_NO_ID)).alias(c) for c in ("anchor_id", "positive_id", "negative_id")}
    return named.select(shown["anchor_id"], shown["positive_id"], "rank", shown["negative_id"], "positive_score", "negative_score")
