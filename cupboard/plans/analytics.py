"""Spending, replenishment, recurring-purchase and search queries.

Every query takes its tables as DataFrames and ``as_of`` (a ``datetime``) instead of the current time,
bound as a literal so that date bounds fold and reach the scan. Date filters have a lower bound only
unless stated: rows dated after ``as_of`` count. Sorted results end their sort key with a unique column,
so that a range of the sort holds no more rows than its share even where many rows tie.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cupboard.functions.dates import days_between
from cupboard.functions.text import like
from cupboard.schemas import ALERT_THRESHOLD
from cupboard.session import write_and_reload

MICROS = 1_000_000
DAY_SECONDS = 86_400
CLOSING = ("empty", "replaced")
HEALTH = ("supplement", "food")


def at(as_of: datetime) -> Column:
    """``as_of`` as a timestamp literal, independent of the client's time zone."""
    return F.lit(f"{as_of:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp")


def month_start(as_of: datetime) -> date:
    return as_of.date().replace(day=1)


def months_back(as_of: datetime, months: int) -> date:
    """Same day some months earlier, overflowing into the next month where that month is too short."""
    first = as_of.date().replace(day=1)
    index = first.year * 12 + first.month - 1 - months
    return date(index // 12, index % 12 + 1, 1) + timedelta(days=as_of.day - 1)


def _since(purchases: DataFrame, first: date) -> DataFrame:
    return purchases.filter(F.col("purchase_date") >= F.lit(first))


def _money(total: Column) -> Column:
    return F.round(total, 2)


def _counted(purchases: DataFrame) -> DataFrame:
    """Purchases, or sums of them (``rollups.sums_of``), with the number ``n`` and the sum ``s`` of what a row stands for."""
    if "s" in purchases.columns:
        return purchases
    return purchases.withColumns({"n": F.lit(1), "s": F.col("price")})


# --- spending ---------------------------------------------------------------------------------

def spend_by_source_month(purchases: DataFrame, as_of: datetime) -> DataFrame:
    return (
        _since(_counted(purchases), month_start(as_of))
        .groupBy("source", "currency")
        .agg(F.sum("n").alias("items"), _money(F.sum("s")).alias("total"))
        .select("source", "items", "total", "currency")
        .orderBy(F.desc("total"), "source", "currency")
    )


def spend_by_category(purchases: DataFrame, possessions: DataFrame, first: date, last: date | None = None) -> DataFrame:
    """Spending by the purchase's category, else the possession's; currencies mixed.

    Purchases are summed per (category, possession) before the join: a possession named by a third of
    all purchases, or by none of them, then brings one row.
    """
    rows = _since(_counted(purchases), first)
    if last is not None:
        rows = rows.filter(F.col("purchase_date") <= F.lit(last))
    sums = (
        rows.select("category", F.when(F.col("category").isNull(), F.col("possession_id")).alias("possession_id"), "n", "s")
        .groupBy("category", "possession_id")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    owned = possessions.select(F.col("id").alias("possession_id"), F.col("category").alias("owned_category"))
    return (
        sums.join(owned, "possession_id", "left")
        .withColumn("spend_category", F.coalesce("category", "owned_category", F.lit("uncategorized")))
        .groupBy("spend_category")
        .agg(F.sum("n").alias("items"), _money(F.sum("s")).alias("total"))
        .select(F.col("spend_category").alias("category"), "items", "total")
        .orderBy(F.desc("total"), "category")
    )


def spend_by_category_month(purchases: DataFrame, possessions: DataFrame, as_of: datetime) -> DataFrame:
    return spend_by_category(purchases, possessions, month_start(as_of))


def spend_monthly_trend(purchases: DataFrame, as_of: datetime, months: int = 6) -> DataFrame:
    return (
        _since(_counted(purchases), months_back(as_of, months))
        .groupBy(F.date_format("purchase_date", "yyyy-MM").alias("month"))
        .agg(F.sum("n").alias("items"), _money(F.sum("s")).alias("total"))
        .orderBy("month")
    )


def health_spend_month(purchases: DataFrame, as_of: datetime) -> DataFrame:
    return (
        _since(_counted(purchases), month_start(as_of))
        .filter(F.col("category").isin(*HEALTH))
        .groupBy("currency")
        .agg(F.sum("n").alias("items"), _money(F.sum("s")).alias("total"))
    )


def week_of(as_of: datetime) -> tuple[date, date]:
    """Monday and Sunday of the week that holds ``as_of``."""
    monday = as_of.date() - timedelta(days=as_of.weekday())
    return monday, monday + timedelta(days=6)


def weekly_spend_report(purchases: DataFrame, as_of: datetime) -> DataFrame:
    """Week's spending per source and currency, and per currency over all sources (``source`` NULL).

    The rollup runs over the sums, not over the purchases.
    """
    first, last = week_of(as_of)
    sums = (
        _counted(purchases).filter(F.col("purchase_date").between(F.lit(first), F.lit(last)))
        .groupBy("source", "currency")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    return (
        sums.groupingSets([[F.col("currency"), F.col("source")], [F.col("currency")]], "currency", "source")
        .agg(
            F.sum("n").alias("items"), _money(F.sum("s")).alias("total"),
            (F.grouping("source") == 1).alias("is_total"),
        )
        .select("source", "currency", "items", "total", "is_total")
    )


def month_over_month(purchases: DataFrame, as_of: datetime) -> DataFrame:
    """Previous full month beside the current month up to ``as_of``, per currency."""
    current = month_start(as_of)
    previous = months_back(datetime(current.year, current.month, 1), 1)
    day = F.col("purchase_date")
    is_current = day >= F.lit(current)
    return (
        _counted(purchases).filter(day.between(F.lit(previous), F.lit(as_of.date())))
        .groupBy("currency")
        .agg(
            _money(F.sum(F.when(~is_current, F.col("s")))).alias("previous_total"),
            F.sum(F.when(~is_current, F.col("n")).otherwise(0)).alias("previous_items"),
            _money(F.sum(F.when(is_current, F.col("s")))).alias("current_total"),
            F.sum(F.when(is_current, F.col("n")).otherwise(0)).alias("current_items"),
        )
    )


def _bought_in_year(purchases: DataFrame, as_of: datetime) -> DataFrame:
    return (
        _since(purchases, months_back(as_of, 12))
        .groupBy("item_name")
        .agg(
            F.count("*").alias("purchase_count"),
            F.round(F.avg("price"), 6).alias("avg_price"),
            F.max("purchase_date").alias("last_purchased"),
        )
    )


def recurring_purchases(purchases: DataFrame, as_of: datetime, min_count: int = 2) -> DataFrame:
    return (
        _bought_in_year(purchases, as_of)
        .filter(F.col("purchase_count") >= min_count)
        .withColumn("days_since_last", days_between(at(as_of), F.col("last_purchased").cast("timestamp")).cast("int"))
        .orderBy(F.desc("days_since_last"), "item_name")
    )


def price_bounds(counts: DataFrame, quantile: str, parts: int = 64, sort_rows: int = 100_000) -> DataFrame:
    """Per currency the exact ``price_bound``: the price of rank ``ceil(quantile * n)`` among all prices.

    ``counts`` (a written table) has currency, price and ``n``; a price may occur in several rows. While a currency's
    range holds more than ``sort_rows`` rows, splitters from quantile sketches cut it into ``parts`` ranges, one pass
    counts each, and the range that holds the rank stays. Only that one is sorted.
    """
    rank = F.ceil(F.lit(quantile).cast("decimal(10,9)") * F.sum("n")).cast("long")
    state = counts.groupBy("currency").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.lit(0).cast("long").alias("below"), rank.alias("rank"),
        F.count("*").alias("rows"))

    def first_reaching(rows: DataFrame, order: str) -> DataFrame:
        """The first row at which the counts reach the rank, with the count before it."""
        upto = F.sum("n").over(Window.partitionBy("currency").orderBy(order))
        reached = rows.withColumn("upto", F.col("below") + upto).filter("upto >= rank")
        return reached.groupBy("currency").agg(F.min_by(F.struct(*reached.columns), order).alias("r")).select("r.*")

    inside = F.col("price").between(F.col("low"), F.col("high"))
    while (state.agg(F.max(F.when(F.col("low") < F.col("high"), F.col("rows")))).first()[0] or 0) > sort_rows:
        held = counts.join(state.drop("rows"), "currency").filter(inside)
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = held.groupBy("currency").agg(F.percentile_approx("price", shares, F.lit(100 * parts)).alias("cuts"))
        part = F.size(F.filter("cuts", lambda cut: cut < F.col("price")))
        ranges = held.join(write_and_reload(cuts), "currency").groupBy("currency", "below", "rank", part.alias("part")).agg(
            F.sum("n").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("rows"))
        state = write_and_reload(first_reaching(ranges, "part").select(
            "currency", "low", "high", (F.col("upto") - F.col("n")).alias("below"), "rank", "rows"))
    held = counts.join(state.drop("rows"), "currency").filter(inside)
    last = held.groupBy("currency", "below", "rank", "price").agg(F.sum("n").alias("n"))
    return first_reaching(last, "price").select("currency", F.col("price").alias("price_bound"))


def wasteful_purchases(purchases: DataFrame, as_of: datetime, quantile: str = "0.9", max_count: int = 1) -> DataFrame:
    """Items bought at most ``max_count`` times in a year at a price in the currency's top share, exactly.

    Purchases are counted by item and price once; items and price bounds come from the counts.
    """
    year = _since(purchases, months_back(as_of, 12)).filter(F.col("price").isNotNull())
    counts = write_and_reload(year.groupBy("currency", "item_name", "price").agg(
        F.count("*").alias("n"), F.max("purchase_date").alias("last_purchased")))
    per_item = counts.groupBy("currency", "item_name").agg(
        F.sum("n").alias("purchase_count"), F.max("price").alias("price"), F.max("last_purchased").alias("last_purchased"))
    # One row per currency code, and the size check of the planner decides how it travels.
    return (
        per_item.filter(F.col("purchase_count") <= max_count)
        .join(price_bounds(counts, quantile), "currency")
        .filter(F.col("price") >= F.col("price_bound"))
        .select("item_name", "currency", "price", "purchase_count", "last_purchased")
        .orderBy(F.desc("price"), "item_name", "currency")
    )


# --- consumables ------------------------------------------------------------------------------

def _replenished(possessions: DataFrame) -> DataFrame:
    return possessions.filter(F.col("is_consumable") & F.col("last_replenished").isNotNull())


def _after(days: Column) -> Column:
    return F.date_add("last_replenished", days)


def _days_until(day: Column, as_of: datetime) -> Column:
    return days_between(day.cast("timestamp"), at(as_of))


def consumables_alert(possessions: DataFrame, as_of: datetime, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Consumables past the threshold share of their lifespan."""
    alert = _after((F.col("estimated_lifespan_days") * threshold).cast("int"))
    return (
        _replenished(possessions)
        .filter(alert.cast("timestamp") <= at(as_of))
        .select(
            "id", "name", "brand", "last_replenished", "estimated_lifespan_days",
            _after(F.col("estimated_lifespan_days")).alias("estimated_empty_date"),
            F.round(_days_until(alert, as_of), 6).alias("days_until_alert"),
        )
        .orderBy("days_until_alert", "id")
    )


def consumables_due_week(possessions: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Consumables that run out within some days, overdue ones included; days left truncate toward zero."""
    empty = _after(F.col("estimated_lifespan_days"))
    left = _days_until(empty, as_of)
    return (
        _replenished(possessions)
        .filter(left <= days)
        .withColumns({"estimated_empty": empty, "days_remaining": left.cast("int")})
        .orderBy("days_remaining", "id")
        .select("name", "brand", "last_replenished", "estimated_lifespan_days", "estimated_empty", "days_remaining")
    )


def consumable_status_daily(possessions: DataFrame, as_of: datetime, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Every replenished consumable as ``replenish`` or ``fine``, with whole days left."""
    lifespan = F.col("estimated_lifespan_days")
    alert = _after((lifespan * threshold).cast("int"))
    return (
        _replenished(possessions)
        .filter(lifespan.isNotNull())
        .select(
            "id", "name",
            F.when(alert.cast("timestamp") <= at(as_of), "replenish").otherwise("fine").alias("status"),
            _days_until(_after(lifespan), as_of).cast("int").alias("days_remaining"),
        )
        .orderBy(F.desc("status"), "days_remaining", "id")
    )


def _fold(events: DataFrame, keys: list[str], unit: str, width: int) -> DataFrame:
    """Fold one level of time units into the next: pairs across units are added from running sums.

    In: one row per (keys, unit) with counts and sums of offsets of openings and closings inside the
    unit, in microseconds, and the pairs found so far. Out: the same per keys, offsets from the start
    of the wider unit.
    """
    before = Window.partitionBy(*keys).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col(unit) * F.lit(float(width))
    shifted = events.withColumns({
        "opened_at": F.col("opened_at") + start * F.col("opened"),
        "closed_at": F.col("closed_at") + start * F.col("closed"),
    })
    zero = F.lit(0.0)
    running = shifted.withColumns({
        "opened_before": F.coalesce(F.sum("opened").over(before), zero),
        "opened_at_before": F.coalesce(F.sum("opened_at").over(before), zero),
    })
    return running.groupBy(*keys).agg(
        F.sum("opened").alias("opened"), F.sum("opened_at").alias("opened_at"),
        F.sum("closed").alias("closed"), F.sum("closed_at").alias("closed_at"),
        F.sum(F.col("pairs") + F.col("opened_before") * F.col("closed")).alias("pairs"),
        F.sum(
            F.col("micros") + F.col("opened_before") * F.col("closed_at") - F.col("opened_at_before") * F.col("closed")
        ).alias("micros"),
    )


def cycle_lengths(log: DataFrame) -> DataFrame:
    """Per possession, the mean days over all pairs of an opening and a strictly later closing event.

    No pair is ever formed. Events at one instant become one row; then instants fold into seconds,
    seconds into days and days into possessions. No window holds more than a million instants, 86,400
    seconds or the days of the log, whatever share of the log one possession has.
    """
    micros = F.unix_micros("logged_at")
    kind = F.col("event_type")
    instants = (
        log.filter(kind.isin("opened", *CLOSING))
        .groupBy("possession_id", micros.alias("t"))
        .agg(
            F.sum(F.when(kind == "opened", 1.0).otherwise(0.0)).alias("opened"),
            F.sum(F.when(kind == "opened", 0.0).otherwise(1.0)).alias("closed"),
        )
    )
    spread = instants.select(
        "possession_id",
        F.expr(f"t div {MICROS * DAY_SECONDS}").alias("day"),
        F.expr(f"(t div {MICROS}) % {DAY_SECONDS}").alias("second"),
        F.expr(f"t % {MICROS}").alias("instant"),
        "opened", "closed",
        F.lit(0.0).alias("opened_at"), F.lit(0.0).alias("closed_at"), F.lit(0.0).alias("pairs"), F.lit(0.0).alias("micros"),
    )
    seconds = _fold(spread, ["possession_id", "day", "second"], "instant", 1)
    days = _fold(seconds, ["possession_id", "day"], "second", MICROS)
    whole = _fold(days, ["possession_id"], "day", MICROS * DAY_SECONDS)
    return whole.filter("pairs > 0").select(
        "possession_id", (F.col("micros") / F.col("pairs") / (MICROS * DAY_SECONDS)).alias("cycle_days")
    )


def consumption_cycle(log: DataFrame, possessions: DataFrame) -> DataFrame:
    named = possessions.select(F.col("id").alias("possession_id"), "name")
    return cycle_lengths(log).join(named, "possession_id").select(
        F.col("possession_id").alias("id"), "name", F.round("cycle_days", 6).alias("avg_cycle_days")
    )


def replenish_forecast_learned(
    possessions: DataFrame, log: DataFrame, as_of: datetime, threshold: float = ALERT_THRESHOLD
) -> DataFrame:
    """Alerts by the learned cycle where there is one, by the default lifespan elsewhere."""
    learned = cycle_lengths(log).select(F.col("possession_id").alias("id"), "cycle_days")
    # Rounded first, so that the whole-day cut below does not hang on the last bit of a mean.
    days = F.coalesce(F.round("cycle_days", 6), F.col("estimated_lifespan_days").cast("double"))
    alert = _after(F.floor(F.round(days * threshold, 6)).cast("int"))
    return (
        _replenished(possessions).join(learned, "id", "left")
        .filter(alert.cast("timestamp") <= at(as_of))
        .select(
            "id", "name", F.round(days, 6).alias("cycle_days"), F.col("cycle_days").isNotNull().alias("is_learned"),
            alert.alias("alert_date"), F.round(_days_until(alert, as_of), 6).alias("days_until_alert"),
        )
        .orderBy("days_until_alert", "id")
    )


def shopping_list(purchases: DataFrame, possessions: DataFrame, as_of: datetime, min_count: int = 2) -> DataFrame:
    """Consumables that run out and items bought regularly, one row per item with an estimated price.

    An item on both lists is named as running out. One pass over the year's purchases gives both the
    regular items and every price.
    """
    due = consumables_due_week(possessions, as_of).groupBy(F.col("name").alias("item_name")).agg(
        F.min("days_remaining").alias("days_remaining"), F.lit("running_out").alias("due")
    )
    bought = _bought_in_year(purchases, as_of).filter(F.col("item_name").isNotNull())
    return (
        due.join(bought, "item_name", "full")
        .filter(F.col("due").isNotNull() | (F.col("purchase_count") >= min_count))
        .select(
            "item_name", F.coalesce("due", F.lit("regular")).alias("reason"), "days_remaining",
            F.col("avg_price").alias("estimated_price"),
        )
    )


def stock_vs_activity(possessions: DataFrame, activity: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Recent activity per category beside the consumables in stock for it.

    ``activity`` has category, logged_at and amount. Both sides are summed per category before the join.
    """
    recent = (
        activity.filter((F.col("logged_at") > at(as_of - timedelta(days=days))) & (F.col("logged_at") <= at(as_of)))
        .groupBy("category")
        .agg(F.count("*").alias("sessions"), F.round(F.sum("amount"), 2).alias("amount"))
    )
    left = _days_until(_after(F.col("estimated_lifespan_days")), as_of).cast("int")
    stock = (
        _replenished(possessions).filter(F.col("estimated_lifespan_days").isNotNull())
        .groupBy("category")
        .agg(F.count("*").alias("items"), F.min(left).alias("least_days_left"), F.count_if(left <= 7).alias("running_out"))
    )
    return recent.join(stock, "category", "left").select(
        "category", "sessions", "amount",
        F.coalesce("items", F.lit(0).cast("long")).alias("items"), "least_days_left",
        F.coalesce("running_out", F.lit(0).cast("long")).alias("running_out"),
    )


# --- possessions ------------------------------------------------------------------------------

def possessions_by_category(possessions: DataFrame) -> DataFrame:
    return possessions.groupBy("category").count().orderBy(F.desc("count"), "category")


def possessions_by_location(possessions: DataFrame) -> DataFrame:
    return possessions.filter(F.col("location").isNotNull()).groupBy("location").count().orderBy(F.desc("count"), "location")


def latest_possessions(possessions: DataFrame, limit: int = 10) -> DataFrame:
    return possessions.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select(
        "name", "brand", "category", "created_at"
    )


def search_by_category(possessions: DataFrame, category: str) -> DataFrame:
    return possessions.filter(F.col("category") == category)


def search_by_location(possessions: DataFrame, pattern: str) -> DataFrame:
    return possessions.filter(like("location", pattern))


def search_free_text(possessions: DataFrame, pattern: str) -> DataFrame:
    return possessions.filter(like("name", pattern) | like("brand", pattern) | like("notes", pattern))


def weekly_new_items(possessions: DataFrame, as_of: datetime) -> DataFrame:
    first, last = week_of(as_of)
    day = F.to_date("created_at")
    return possessions.filter(day.between(F.lit(first), F.lit(last))).select("id", "name", "category")


def weekly_consumed(log: DataFrame, possessions: DataFrame, as_of: datetime, events: tuple[str, ...] = ("empty",)) -> DataFrame:
    first, last = week_of(as_of)
    rows = log.filter(F.col("event_type").isin(*events) & F.to_date("logged_at").between(F.lit(first), F.lit(last)))
    named = possessions.select(F.col("id").alias("possession_id"), "name")
    return rows.join(named, "possession_id").select(
        "possession_id", "name", "event_type", F.to_date("logged_at").alias("logged_on")
    )
