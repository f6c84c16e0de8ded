import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cupboard.functions.dates import days_between
from cupboard.plans import analytics as Q
from cupboard.session import write_and_reload
from cupboard.schemas import POSSESSIONS

AS_OF = datetime(2026, 3, 10, 9, 30)
PURCHASE = "source string, item_name string, price double, currency string, purchase_date date, category string, possession_id long"


def owned(spark, rows):
    base = {f.name: None for f in POSSESSIONS.fields}
    base.update(condition="good", is_consumable=True, created_at=datetime(2026, 1, 1), category="food")
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], POSSESSIONS)


def logged(spark, rows):
    return spark.createDataFrame(
        [(i, p, e, t) for i, (p, e, t) in enumerate(rows)], "id long, possession_id long, event_type string, logged_at timestamp")


def test_lower_bound_only_and_null_prices(spark):
    bought = spark.createDataFrame([
        ("s", "a", None, "JPY", date(2026, 3, 1), None, None), ("t", "a", 5.0, "JPY", date(2027, 1, 1), None, None),
        ("t", "a", 5.0, "JPY", date(2026, 2, 28), None, None),
    ], PURCHASE)
    rows = {r.source: (r["items"], r.total) for r in Q.spend_by_source_month(bought, AS_OF).collect()}
    assert rows == {"s": (1, None), "t": (1, 5.0)}


def test_category_of_the_possession_stands_in(spark):
    day = date(2026, 3, 2)
    bought = spark.createDataFrame([
        ("s", "a", 1.0, "JPY", day, None, 1), ("s", "a", 2.0, "JPY", day, None, 1), ("s", "a", 4.0, "JPY", day, "kitchen", 1),
        ("s", "a", 8.0, "JPY", day, None, None), ("s", "a", 16.0, "JPY", day, None, 99),
    ], PURCHASE)
    rows = Q.spend_by_category_month(bought, owned(spark, [{"id": 1, "name": "x"}]), AS_OF).collect()
    assert {r.category: (r["items"], r.total) for r in rows} == {
        "food": (2, 3.0), "kitchen": (1, 4.0), "uncategorized": (2, 24.0)}


def test_alert_at_the_threshold(spark):
    rows = owned(spark, [
        {"id": 1, "name": "due", "estimated_lifespan_days": 9, "last_replenished": date(2026, 3, 3)},
        {"id": 2, "name": "fine", "estimated_lifespan_days": 10, "last_replenished": date(2026, 3, 3)},
        {"id": 3, "name": "no lifespan", "last_replenished": date(2020, 1, 1)},
    ])
    row, = Q.consumables_alert(rows, AS_OF).collect()
    assert (row.id, row.estimated_empty_date) == (1, date(2026, 3, 12))
    assert row.days_until_alert == pytest.approx(-9.5 / 24, abs=1e-6)
    left = {r.name: r.days_remaining for r in Q.consumables_due_week(rows, AS_OF).collect()}
    assert left == {"due": 1, "fine": 2}
    status = {r.name: r.status for r in Q.consumable_status_daily(rows, AS_OF).collect()}
    assert status == {"due": "replenish", "fine": "fine"}


def cycle_lengths_by_pairs(log):
    """The same by joining the pairs."""
    opened = log.filter("event_type = 'opened'").select("possession_id", F.col("logged_at").alias("opened_at"))
    closed = log.filter("event_type IN ('empty', 'replaced')").select("possession_id", F.col("logged_at").alias("closed_at"))
    pairs = opened.join(closed, "possession_id").filter("closed_at > opened_at")
    return pairs.groupBy("possession_id").agg(F.avg(days_between(F.col("closed_at"), F.col("opened_at"))).alias("cycle_days"))


@pytest.mark.parametrize("seed", range(4))
def test_cycles_agree_with_the_pair_join(spark, seed):
    rng = random.Random(seed)
    start = datetime(1969, 12, 31, 23, 59, 58) if seed == 0 else datetime(2026, 1, 1)
    spread = [0, 1, 999_999, 1_000_000, 86_400_000_000, 86_399_999_999, 5 * 86_400_000_000]
    rows = [
        (rng.randint(1, 4), rng.choice(["opened", "empty", "replaced", "low"]),
         start + timedelta(microseconds=rng.choice(spread) * rng.randint(0, 2) + rng.choice([0, 0, 1, 7])))
        for _ in range(150)
    ] + [(9, "opened", start), (9, "empty", start), (8, "empty", start), (8, "opened", start + timedelta(days=1))]
    log = logged(spark, rows)
    got = {r.possession_id: r.cycle_days for r in Q.cycle_lengths(log).collect()}
    want = {r.possession_id: r.cycle_days for r in cycle_lengths_by_pairs(log).collect()}
    assert got.keys() == want.keys() and 9 not in got and 8 not in got
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_cycles_of_one_hot_possession_form_no_pairs(spark):
    log = spark.range(40_000).selectExpr(
        "id", "1L AS possession_id", "CASE WHEN id % 2 = 0 THEN 'opened' ELSE 'empty' END AS event_type",
        "timestamp_micros(1700000000000000 + id * 60000000) AS logged_at")
    plan = Q.cycle_lengths(log)._jdf.queryExecution().toString()
    assert "Join" not in plan
    n = 20_000  # opening i and closing j >= i are (2 (j - i) + 1) minutes apart
    pairs = n * (n + 1) // 2
    minutes = sum((2 * k + 1) * (n - k) for k in range(n))
    assert Q.cycle_lengths(log).first().cycle_days == pytest.approx(minutes / pairs / 1440, rel=1e-9)


def test_forecast_prefers_what_was_learned(spark):
    rows = owned(spark, [
        {"id": 1, "name": "a", "estimated_lifespan_days": 100, "last_replenished": date(2026, 3, 1)},
        {"id": 2, "name": "b", "estimated_lifespan_days": 100, "last_replenished": date(2026, 3, 1)},
    ])
    log = logged(spark, [(1, "opened", datetime(2026, 1, 1)), (1, "empty", datetime(2026, 1, 11))])
    row, = Q.replenish_forecast_learned(rows, log, AS_OF).collect()
    assert (row.id, row.cycle_days, row.is_learned, row.alert_date) == (1, 10.0, True, date(2026, 3, 9))


def test_like_is_literal_about_backslashes_and_ignores_case(spark):
    rows = owned(spark, [{"id": 1, "name": "a\\b", "location": "Kitchen shelf"}, {"id": 2, "name": "ab", "notes": "A RING"}])
    assert [r.id for r in Q.search_free_text(rows, "%a\\b%").collect()] == [1]
    assert [r.id for r in Q.search_free_text(rows, "%ring%").collect()] == [2]
    assert [r.id for r in Q.search_by_location(rows, "kitchen%").collect()] == [1]


def test_latest_uses_a_bounded_sort(spark):
    plan = Q.latest_possessions(owned(spark, [{"id": 1, "name": "x"}]))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_week_and_quantile(spark):
    assert Q.week_of(datetime(2026, 3, 8, 20)) == (date(2026, 3, 2), date(2026, 3, 8))
    bought = spark.createDataFrame([
        ("s", f"item {i}", float(i), "JPY", date(2026, 3, 1), None, None) for i in range(1, 101)
    ] + [("s", "twice", 500.0, "JPY", date(2026, 3, 1), None, None)] * 2, PURCHASE)
    got = sorted(r.item_name for r in Q.wasteful_purchases(bought, AS_OF).collect())
    assert got == sorted(f"item {i}" for i in range(92, 101))


@pytest.mark.parametrize("sort_rows", [100_000, 50])
def test_price_bounds_are_exact(spark, sort_rows):
    """More than 100,000 distinct prices, most of them close together beside a few far out; ties at the bound, and one
    price in many rows. With few rows to sort, splitters narrow the range again and again."""
    prices = [1 + i / 1e6 for i in range(120_000)] + [1e12, 5e8, -3.0] + [1.05] * 500
    rows = spark.createDataFrame([("JPY", p) for p in prices] + [("USD", 2.0), ("EUR", 1.0), ("EUR", 3.0)], "currency string, price double")
    counts = write_and_reload(rows.withColumn("n", F.lit(1)).unionByName(spark.createDataFrame([("GBP", 7.0, 4), ("GBP", 8.0, 96)], "currency string, price double, n int")))
    for quantile in ("0.9", "0.5", "0.999999", "1"):
        got = {r.currency: r.price_bound for r in Q.price_bounds(counts, quantile, sort_rows=sort_rows).collect()}
        rank = math.ceil(Decimal(quantile) * len(prices))
        assert got == {"JPY": sorted(prices)[rank - 1], "USD": 2.0, "EUR": 3.0 if Decimal(quantile) > Decimal("0.5") else 1.0, "GBP": 8.0}
