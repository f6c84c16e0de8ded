"""Scheduled reports: several queries as one table of rows by section."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard.operators.rollups import sums_of
from cupboard.plans import analytics as Q
from cupboard.session import write_and_reload


def _section(df: DataFrame, section: str, label: Column, number: Column, unit: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), label.cast("string").alias("label"), number.cast("double").alias("number"),
        unit.cast("string").alias("unit"), detail.cast("string").alias("detail"),
    )


def daily_consumable_check(possessions: DataFrame, as_of: datetime) -> DataFrame:
    return Q.consumable_status_daily(possessions, as_of)


def weekly_life_report(
    purchases: DataFrame, possessions: DataFrame, log: DataFrame, as_of: datetime, log_as_of: datetime | None = None
) -> DataFrame:
    """Spending, new items, items used up, items due and the month's trend, as rows of named sections."""
    first, last = Q.week_of(as_of)
    none = F.lit(None)
    # The purchases are read once: three sections come from their sums by day.
    earliest = min(first, Q.months_back(as_of.replace(day=1), 1))
    sums = write_and_reload(sums_of(purchases.filter(F.col("purchase_date") >= F.lit(earliest))))
    spend = Q.weekly_spend_report(sums, as_of)
    categories = Q.spend_by_category(sums, possessions, first, last)
    added = Q.weekly_new_items(possessions, as_of)
    consumed = Q.weekly_consumed(log, possessions, log_as_of or as_of)
    due = Q.consumables_due_week(possessions, as_of)
    trend = Q.month_over_month(sums, as_of)
    return reduce(DataFrame.unionByName, [
        _section(spend, "spend", F.coalesce("source", F.lit("total")), F.col("total"), F.col("currency"), F.col("items")),
        _section(categories, "category", F.col("category"), F.col("total"), none, F.col("items")),
        _section(added, "new_item", F.col("name"), F.col("id"), none, F.col("category")),
        _section(consumed, "consumed", F.col("name"), F.col("possession_id"), F.col("event_type"), F.col("logged_on")),
        _section(due, "due", F.col("name"), F.col("days_remaining"), F.lit("days"), F.col("estimated_empty")),
        _section(trend, "previous_month", F.col("currency"), F.col("previous_total"), F.col("currency"), F.col("previous_items")),
        _section(trend, "current_month", F.col("currency"), F.col("current_total"), F.col("currency"), F.col("current_items")),
    ])


def weekly_purchase_suggestion(purchases: DataFrame, possessions: DataFrame, as_of: datetime) -> DataFrame:
    return Q.shopping_list(purchases, possessions, as_of)
