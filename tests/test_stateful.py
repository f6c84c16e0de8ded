"""Keyed state and timers of streams against the batch rules."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cupboard.operators.dedupe import accept_by_order
from cupboard.streaming import stateful

ROWS = "rn long, source string, item_name string, price double, order_id string"


def test_first_orders_over_triggers_restarts_and_replays(spark, tmp_path):
    """Files arrive in three parts, each run ends and starts again; a run without new files changes nothing."""
    stored = spark.createDataFrame([(0, "s", "old", 1.0, "o0"), (0, "s", "old", 1.0, None)], ROWS)
    parts = [[(1, "s", "a", 1.0, "o0"), (3, "s", "c", 1.0, "o1"), (2, "s", "b", None, "o1"), (4, "t", None, 1.0, "o1"), (5, "s", "x", 1.0, "")],
             [(6, "s", "d", 1.0, "o1"), (7, "s", "e", 1.0, "o2"), (8, "s", "x", 1.0, None)], [(9, "s", "f", 1.0, "o2"), (10, "t", "g", 1.0, "o0")]]
    seen = []
    for part in parts:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen += part
        for _ in range(2):
            stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
            got = stateful.run_to_end(stateful.first_orders(stream, ["rn"], stored), str(tmp_path / "out"))
            want = accept_by_order(spark.createDataFrame(seen, ROWS), stored, ["rn"])
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_first_orders_share_a_call_by_bucket(spark, tmp_path):
    """Many orders go through few calls; each is still looked up on its own, also without a source and after a restart."""
    rows = [(n * 7 % 300, [None, "s", "t"][n % 3], "a", float(n), f"o{n * 7 % 300 // 4}") for n in range(300)]
    stored = spark.createDataFrame([(0, s, "old", 1.0, f"o{k}") for k in range(0, 75, 5) for s in ("s", None)], ROWS)
    for buckets in (1, 5):
        path, seen = tmp_path / str(buckets), []
        for part in (rows[:200], rows[200:]):
            spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(path / "in"))
            stream = spark.readStream.schema(ROWS).parquet(str(path / "in"))
            got = stateful.run_to_end(stateful.first_orders(stream, ["rn"], stored, buckets), str(path / "out"))
            taken = {(r[1], r[4]) for r in seen} | {(r.source, r.order_id) for r in stored.collect()}
            for row in sorted(part, key=lambda r: r[0]):
                if (row[1], row[4]) not in taken:
                    taken.add((row[1], row[4]))
                    seen.append(row)
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, seen))


def run(spark, folder, rows):
    schema = "possession_id long, lifespan_days int, replenished_at timestamp, seen_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    changes = spark.readStream.schema(schema).parquet(f"{folder}/in").withWatermark("seen_at", "0 seconds")
    got = stateful.run_to_end(stateful.lifespan_alerts(changes), f"{folder}/out")
    return sorted((r.possession_id, r.last_replenished, r.alert_on) for r in got.collect())


def test_alerts_fire_once_move_and_start_again(spark, tmp_path):
    def at(month, day):
        return datetime(2026, month, day, 8)

    first = run(spark, tmp_path, [(1, 10, None, at(1, 1)), (2, 10, None, at(1, 1)), (3, None, at(1, 1), at(1, 1)), (1, None, at(1, 1), at(1, 1)),
                                  (2, None, at(1, 1), at(1, 1)), (-1, None, None, at(1, 7))])
    assert first == []
    second = run(spark, tmp_path, [(2, None, at(1, 8), at(1, 8)), (-1, None, None, at(1, 12))])
    assert second == [(1, date(2026, 1, 1), date(2026, 1, 9))]  # the second one was replenished in time
    third = run(spark, tmp_path, [(1, None, at(1, 12), at(1, 13)), (3, 5, None, at(1, 13)), (-1, None, None, at(1, 17))])
    assert third == [(1, date(2026, 1, 1), date(2026, 1, 9)), (2, date(2026, 1, 8), date(2026, 1, 16)), (3, date(2026, 1, 1), date(2026, 1, 5))]
    assert run(spark, tmp_path, [(-1, None, None, at(2, 1))]) == sorted([*third, (1, date(2026, 1, 12), date(2026, 1, 20))])
