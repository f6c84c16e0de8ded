import random
from datetime import date

import pytest

from cupboard.operators.dedupe import accept_by_order, accept_new, accept_possessions, drop_empty, without_seen

COLUMNS = "rn long, source string, item_name string, purchase_date date, price double, order_id string"


def sequential(rows, target, composite=True):
    """First-wins load, row by row."""
    stored, kept = [r[1:] for r in target], []
    for row in sorted(rows):
        _, source, item, day, price, order_id = row
        if order_id:
            if any(s == source and o == order_id for s, _, _, _, o in stored):
                continue
        elif composite and item and day is not None and price is not None:
            if any((s, i, d, p) == (source, item, day, price) for s, i, d, p, _ in stored):
                continue
        stored.append(row[1:])
        kept.append(row[0])
    return kept


def run(spark, rows, target, accept=accept_new):
    frame = spark.createDataFrame(rows, COLUMNS)
    history = spark.createDataFrame(target, COLUMNS) if target is not None else None
    return sorted(r.rn for r in accept(frame, history, ["rn"]).collect())


D1 = date(2026, 1, 1)


def test_golden(spark):
    rows = [
        (0, "s", "a", D1, 1.0, "o1"), (1, "s", "b", D1, 2.0, "o1"), (2, "s", "a", D1, 1.0, None),
        (3, "s", "c", None, 3.0, None), (4, "s", "c", None, 3.0, None), (5, "s", "", D1, 9.0, None), (6, "s", "", D1, None, ""),
    ]
    frame = drop_empty(spark.createDataFrame(rows, COLUMNS))
    assert sorted(r.rn for r in accept_new(frame, None, ["rn"]).collect()) == [0, 3, 4, 5]


@pytest.mark.parametrize("seed", range(6))
def test_random_against_a_sequential_load(spark, seed):
    rng = random.Random(seed)

    def row(rn):
        return (
            rn, rng.choice("st"), rng.choice(["a", "b", "", None]), rng.choice([D1, date(2026, 1, 2), None]),
            rng.choice([1.0, 2.0, None]), rng.choice([None, "", "o1", "o2", "o3", "o4"]),
        )

    for _ in range(4):
        rows = [row(i) for i in range(rng.randint(1, 40))]
        target = [row(-1) for _ in range(rng.randint(0, 6))]
        assert run(spark, rows, target) == sequential(rows, target)
        assert run(spark, rows, None) == sequential(rows, [])
        assert run(spark, rows, target, accept_by_order) == sequential(rows, target, composite=False)


def test_hot_keys_shrink_before_the_shuffle(spark):
    """A third of the rows in one order and a third in one composite key; both keep one row per task."""
    n = 30_000
    rows = spark.range(n).selectExpr(
        "id AS rn", "'s' AS source", "'a' AS item_name", "DATE'2026-01-01' AS purchase_date",
        "CASE WHEN id % 3 = 2 THEN CAST(id AS DOUBLE) ELSE 1.0D END AS price",
        "CASE WHEN id % 3 = 0 THEN 'hot' END AS order_id",
    )
    accepted = accept_new(rows, None, ["rn"])
    plan = accepted._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    # The hot order's first row takes the composite key (a, 1.0) from all rows without an order.
    assert accepted.count() == 1 + n // 3


def test_possessions_first_wins(spark):
    rows = spark.createDataFrame(
        [(1, "Knife", "kitchen"), (2, "Knife", "kitchen"), (3, "Knife", "office"), (4, "Pan", "kitchen")],
        "rn int, name string, category string")
    owned = spark.createDataFrame([("Pan", "kitchen")], "name string, category string")
    assert sorted(r.rn for r in accept_possessions(rows, owned, ["rn"]).collect()) == [1, 3]


def test_two_keys_are_looked_up_with_one_join_each(spark):
    rows = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (3, None, "r"), (4, "c", None), (5, "d", "s")], "id int, hash string, path string")
    seen = spark.createDataFrame([("a", "x"), ("y", "q"), (None, None)], "hash string, path string")
    new = without_seen(rows, seen, ("path",), ("hash",))
    assert sorted(r.id for r in new.collect()) == [3, 4, 5]
    assert new._jdf.queryExecution().analyzed().toString().count("Join LeftAnti") == 2
