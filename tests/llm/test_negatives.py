"""Cover tree invariants, and mined rows against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cupboard.llm import negatives
from cupboard.llm.covertree import Block, CoverTree, augmented, distances

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_every_node_covers_its_members():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-50, 50, (400, 5)), np.repeat(rng.integers(-5, 5, (1, 5)), 300, axis=0), rng.integers(900, 950, (40, 5))])
    square = float((x * x).sum(axis=1).max())
    points = augmented(x, square)
    assert np.allclose((points ** 2).sum(axis=1), square)
    tree = CoverTree.build(points, leaf=16)
    assert sorted(np.concatenate(tree.leaves)) == list(range(len(x)))
    members = list(tree.leaves)
    for depth in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[depth]
        for centre, radius, rows in zip(level.centres, level.radii, members):
            assert distances(points[rows], centre).max() <= radius + 1e-9
        if depth:
            up = [[] for _ in tree.levels[depth - 1].radii]
            for parent, rows in zip(level.parents, members):
                up[parent] += list(rows)
            members = up


@pytest.mark.parametrize("leaf", [1, 8, 64])
def test_block_search_is_exact_and_skips(leaf):
    rng = np.random.default_rng(leaf)
    middles = rng.integers(-200, 200, (12, 8))
    x = (middles[rng.integers(0, 12, 900)] + rng.integers(-4, 5, (900, 8))).astype(np.int64)
    ids, labels = rng.permutation(900).astype(np.int64), rng.integers(0, 3, 900)
    block = Block.of(ids, labels, x, float((x * x).sum(axis=1).max()), leaf)
    at = rng.choice(900, 30, replace=False)
    low, high = np.sort(rng.integers(-60_000, 90_000, (2, 30, 2)), axis=0)
    for same in (True, False):
        found, _ = block.search(ids[at], labels[at], x[at], low, high, 4, same, low)
        got = sorted(zip(found.query.tolist(), found.window.tolist(), found.score.tolist(), found.id.tolist()))
        want = []
        for q, row in enumerate(at):
            score = x @ x[row]
            for w in range(2):
                ok = ((labels == labels[row]) == same) & (np.arange(900) != row) & (score >= low[q, w]) & (score <= high[q, w])
                best = sorted((-score[i], ids[i]) for i in np.flatnonzero(ok))[:4]
                want += [(q, w, int(-s), int(i)) for s, i in best]
        assert got == sorted(want)
    wanted, _ = block.tree.descend(x[at], low, high, 1e-6)
    assert wanted.mean() < 0.9


def brute(rows, is_anchor, positives=5, negatives=10):
    big = (1 << 63) - 1
    good = {(big if i is None else i, l, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v, l in rows
            if l is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for a in good:
        if a[0] == big or not is_anchor(a[0]):
            continue
        score = {b: sum(p * q for p, q in zip(a[2], b[2])) for b in good}
        mine = sorted((-score[b], b[0]) for b in good if b[1] == a[1] and b != a)[:positives]
        for minus, positive in mine:
            s = -minus
            ok = sorted((-score[b], b[0]) for b in good if b[1] != a[1] and 30 * s <= 100 * score[b] <= 90 * s)[:negatives]
            out += [(a[0], positive, r, n, s, -m) for r, (m, n) in enumerate(ok, 1)]
    none = lambda v: None if v == big else v
    return sorted(((none(a), none(p), r, none(n), s, m) for a, p, r, n, s, m in out), key=repr)


@pytest.mark.parametrize("sizes", [dict(), dict(sample_rows=20, cell_rows=10, block_rows=7)])
def test_mined_rows_against_brute_force(spark, sizes):
    rng = np.random.default_rng(7)
    middles = rng.standard_normal((5, 6))
    rows = [(i, [float(np.float32(c)) for c in middles[rng.integers(5)] + rng.standard_normal(6) * 0.4], int(rng.integers(0, 4))) for i in range(250)]
    hot = rows[10][1]
    rows += [(1000 + i, hot, int(rng.integers(0, 3))) for i in range(150)]  # one common vector: ties by id
    rows += [rows[20], rows[20], (40, rows[41][1], 1), (None, rows[3][1], 2), (None, rows[4][1], 2), (300, None, 1), (301, rows[1][1], None),
             (302, [None] + rows[1][1][1:], 1), (303, [float("nan")] + rows[1][1][1:], 1), (304, [float("-inf")] + rows[1][1][1:], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("a")).withColumn("cell", F.lit(1)).repartition(4)
    got = negatives.mined(frame, F.col("vec_id") % 10 == 0, **sizes).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and sorted(map(tuple, got), key=repr) == want


def test_wide_vectors_come_in_smaller_blocks(spark, monkeypatch):
    """Blocks and sample are bounded in numbers too; the result stays the same."""
    monkeypatch.setattr(negatives, "BLOCK_NUMBERS", 1_000)
    monkeypatch.setattr(negatives, "SAMPLE_NUMBERS", 900)
    built = []
    index = negatives.Index
    monkeypatch.setattr(negatives, "Index", lambda rows, d, n, *sizes: built.append((d, *sizes)) or index(rows, d, n, *sizes))
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-3, 5, 30)], int(rng.integers(0, 3))) for i in range(120)]
    got = negatives.mined(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect()
    want = brute(rows, lambda i: i % 10 == 0)
    assert built == [(30, 30, 33, 33)]
    assert len(want) > 100 and sorted(map(tuple, got), key=repr) == want


def test_other_lengths_one_label_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [3.0], 1), (3, [], 0), (100, [2.0, 2.0], 1)], SCHEMA)
    assert negatives.mined(frame, F.col("vec_id") % 100 == 0).count() == 0  # no other label
    for where in ("vec_id = 1", "embedding is null", "false"):
        none = negatives.mined(frame.where(where), F.col("vec_id") % 100 == 0)
        assert none.count() == 0 and none.columns[0] == "anchor_id"


def test_large_entries_stay_exact():
    x = np.array([[1 << 30, 1], [1 << 30, 0], [1 << 30, 2]], np.int64)
    block = Block.of(np.arange(3), np.array([0, 1, 1]), x, float(2 ** 60 + 8))
    low, high = np.array([[-(1 << 62)]]), np.array([[(1 << 62)]])
    found, _ = block.search(np.array([0]), np.array([0]), x[:1], low, high, 2, False, low)
    assert found.score.tolist() == [2 ** 60 + 2, 2 ** 60] and found.id.tolist() == [2, 1]
