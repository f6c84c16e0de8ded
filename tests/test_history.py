"""Sums and key filters kept beside the history."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cupboard.operators import pruning, rollups
from cupboard.operators.dedupe import accept_new
from cupboard.operators.load import append_batch, read_table, with_ids
from cupboard.plans import analytics as Q
from cupboard.schemas import PURCHASE_HISTORY

COLUMNS = "rn long, source string, item_name string, purchase_date date, price double, order_id string"


def NOW():
    return F.lit("2026-04-01 00:00:00").cast("timestamp")


def schema_of(spark):
    return spark.createDataFrame([], COLUMNS).drop("rn").schema


def day(i):
    return date(2020, 1, 1) + timedelta(days=i)


def rows_of(rng, n, first_day, days, orders):
    return [(i, rng.choice("st"), rng.choice(["a", "b", "", None, "cup"]), rng.choice([day(first_day + rng.randrange(days)), None]),
             rng.choice([1.0, -0.0, 2.5, None]), rng.choice([None, "", f"o{orders + rng.randrange(n)}"])) for i in range(n)]


def test_only_files_that_can_hold_a_key_are_compared(spark, tmp_path):
    """Forty daily batches; a new batch repeats rows of three of them. Few files are named, and the result is that of the
    whole history, for a batch that is sent to the filters and for one that is too large for that."""
    rng, path = random.Random(1), str(tmp_path / "t")
    schema, history = schema_of(spark), []
    for b in range(20):
        part = rows_of(rng, 60, 10 * b, 3, 1000 * b)
        history += part
        pruning.append_with_filters(spark.createDataFrame(part, COLUMNS), path, schema, f"b{b}", NOW(), keep_ids=True)
    new = [(i, *r[1:]) for i, r in enumerate(history[60:90] + history[600:640] + rows_of(rng, 50, 900, 2, 90_000))]
    batch = spark.createDataFrame(new, COLUMNS)
    want = sorted(r.rn for r in accept_new(batch, read_table(spark, path, schema), ["rn"]).collect())
    n_files = len(spark.read.parquet(f"{path}/rows").inputFiles())
    named = pruning.possible_files(spark, path, batch)
    assert 2 <= named.count() <= n_files // 3
    for most in (2_000_000, 5):
        target = pruning.read_matching(spark, path, schema, batch, max_keys=most)
        assert sorted(r.rn for r in accept_new(batch, target, ["rn"]).collect()) == want
    none = pruning.possible_files(spark, path, spark.createDataFrame([(0, "s", "new", day(5000), 1.0, "new")], COLUMNS))
    assert none.count() <= 1
    plan = pruning.read_matching(spark, path, schema, batch)
    plan.collect()
    assert "file_path" in plan._jdf.queryExecution().toString()


def test_replaced_batches_and_batches_without_filters(spark, tmp_path):
    path, schema = str(tmp_path / "t"), schema_of(spark)
    one = spark.createDataFrame([(0, "s", "a", day(1), 1.0, "o1"), (1, "s", None, None, None, None)], COLUMNS)
    other = spark.createDataFrame([(0, "s", "b", day(2), 1.0, "o2")], COLUMNS)
    batch = one.unionByName(other)
    assert pruning.read_matching(spark, path, schema, batch) is None
    pruning.append_with_filters(one, path, schema, "x", NOW(), keep_ids=True)
    pruning.append_with_filters(other, path, schema, "x", NOW(), keep_ids=True)  # replaces it
    append_batch(one, path, schema, "y", NOW(), keep_ids=True)  # no filters: always read
    got = pruning.read_matching(spark, path, schema, batch)
    assert sorted((r.batch_id, r.order_id or "") for r in got.collect()) == [("x", "o2"), ("y", ""), ("y", "o1")]
    got = pruning.read_matching(spark, path, schema, spark.createDataFrame([(9, "q", "z", day(9), 9.0, "zz")], COLUMNS))
    assert {r.batch_id for r in got.collect()} == {"y"}


def test_filters_have_no_false_negatives():
    import numpy as np

    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    words = np.zeros((1 << 16) // 64, np.uint64)
    pruning._set_bits(words, pruning._slots(h, 1 << 16))

    def hit(x):
        slots = pruning._slots(x, 1 << 16)
        return ((words[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)).all(axis=1)

    assert hit(h).all() and hit(rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)).mean() < 0.02


PURCHASE = "source string, item_name string, price double, currency string, purchase_date date, category string, possession_id long"


def test_sums_follow_appends_and_reruns_and_no_history_is_read(spark, tmp_path, monkeypatch):
    rng, path, as_of = random.Random(2), str(tmp_path / "p"), datetime(2026, 3, 10, 9, 30)

    def batch(n):
        return [(rng.choice("st"), "i", rng.choice([1.25, 2.5, None]), rng.choice(["JPY", "USD"]), date(2026, rng.randrange(1, 4), rng.randrange(1, 28)),
                 rng.choice(["food", "supplement", None]), rng.choice([1, 2, None])) for _ in range(n)]

    kept = {}
    for name, n in (("a", 80), ("b", 60), ("a", 50)):
        kept[name] = batch(n)
        rollups.append_with_sums(spark.createDataFrame(kept[name], PURCHASE), path, name, NOW())
    whole = spark.createDataFrame(kept["a"] + kept["b"], PURCHASE)
    owned = spark.createDataFrame([(1, "food"), (2, "kitchen")], "id long, category string")
    sums = rollups.read_sums(spark, path)
    assert sums.agg(F.sum("n")).first()[0] == 110
    assert f"{path}/rows" not in sums._jdf.queryExecution().toString()
    for query in (lambda p: Q.spend_by_source_month(p, as_of), lambda p: Q.spend_by_category_month(p, owned, as_of), lambda p: Q.spend_monthly_trend(p, as_of),
                  lambda p: Q.weekly_spend_report(p, as_of), lambda p: Q.month_over_month(p, as_of), lambda p: Q.health_spend_month(p, as_of)):
        assert sorted(map(repr, query(sums).collect())) == sorted(map(repr, query(whole).collect()))
    assert rollups.read_sums(spark, str(tmp_path / "none")) is None
    monkeypatch.setattr(rollups, "append_batch", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        rollups.append_with_sums(whole, path, "c", NOW())
    assert rollups.read_sums(spark, path).agg(F.sum("n")).first()[0] == 110
    assert read_table(spark, path, PURCHASE_HISTORY).count() == 110


def test_numbering_does_not_move_the_rows(spark):
    """Each task's first id comes to the rows, however large the planner takes the counts for."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = with_ids(spark.range(1000, numPartitions=5).withColumnRenamed("id", "n"), 7)
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.id for r in rows.collect()) == list(range(7, 1007))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_written_where_they_are(spark, tmp_path, monkeypatch):
    """A batch is dealt out again before it is written, unless its rows come in good parts."""
    dealt = []
    hint = type(spark.range(1)).hint
    monkeypatch.setattr(type(spark.range(1)), "hint", lambda self, name, *args: (dealt.append(name), hint(self, name, *args))[1])
    rows = spark.range(100).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("item_name"), F.lit("JPY").alias("currency"))
    for in_place, expected in ((True, []), (False, ["rebalance"])):
        path = str(tmp_path / str(in_place))
        append_batch(rows, path, PURCHASE_HISTORY, "b", F.lit(datetime(2026, 1, 1)), in_place=in_place)
        assert dealt == expected and read_table(spark, path, PURCHASE_HISTORY).count() == 100
