"""Changes to possessions and the consumption log, given as batches; what a table must not hold is returned apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupboard.operators.load import conform, next_id, with_ids
from cupboard.operators.normalize import lifespan_of_kind
from cupboard.schemas import CATEGORIES, CONDITIONS, CONSUMPTION_LOG, EVENT_TYPES, POSSESSIONS

CONSUMABLE_CATEGORIES = ("consumable", "food", "supplement", "bathroom")
REPLENISHING = ("opened", "replaced")


def _reason(rules: dict[str, Column]) -> Column:
    """Name of the first rule that a row breaks, else NULL."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return reason


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def register(items: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New possession rows with consumable flag, lifespan and defaults filled in, and those refused with a ``reason``.

    ``kind`` (a consumable kind) gives the lifespan where none is set.
    """
    consumable = F.coalesce("is_consumable", F.coalesce(F.col("category").isin(*CONSUMABLE_CATEGORIES), F.lit(False)))
    filled = (
        items.withColumns({"is_consumable": consumable, "condition": F.coalesce("condition", F.lit("good"))})
        .withColumn("estimated_lifespan_days", F.coalesce(
            "estimated_lifespan_days",
            F.when(F.col("is_consumable"), lifespan_of_kind(F.coalesce("kind", "category", F.lit("")))),
        ))
        .withColumn("created_at", as_of)
    )
    return _split(filled.withColumn("reason", _reason({
        "not_null:name": F.col("name").isNull(),
        "enum:category": ~F.col("category").isin(*CATEGORIES),
        "enum:condition": ~F.col("condition").isin(*CONDITIONS),
    })))


def append_possessions(possessions: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshot with new rows added under fresh ids."""
    numbered = conform(with_ids(new, next_id(possessions)), POSSESSIONS)
    return possessions.unionByName(numbered)


def update(possessions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``(id, column_name, value, seq)`` changes; of several to one cell the highest ``seq`` that is valid wins.

    Values are text; NULL sets the cell to NULL. Returns the new snapshot and the changes refused, with a ``reason``:
    an unknown column, a possession that does not exist, a NULL in a required column, a value outside an
    enumeration, or one that its column's type cannot read.
    """
    columns = [f for f in possessions.schema.fields if f.name != "id"]
    name, value = F.col("column_name"), F.col("value")
    readable = F.lit(True)
    for f in columns:
        readable = F.when(name == f.name, value.try_cast(f.dataType).isNotNull()).otherwise(readable)
    required = [f.name for f in POSSESSIONS.fields if not f.nullable]
    known = possessions.select(F.col("id"), F.lit(True).alias("exists"))
    judged = changes.join(known, "id", "left").withColumn("reason", _reason({
        "unknown_column": name.isNull() | ~name.isin(*[f.name for f in columns]),
        "unknown_id": F.col("exists").isNull(),
        "not_null": value.isNull() & name.isin(*required),
        "enum": ((name == "category") & ~value.isin(*CATEGORIES)) | ((name == "condition") & ~value.isin(*CONDITIONS)),
        "unreadable": value.isNotNull() & ~readable,
    })).drop("exists")
    valid, refused = _split(judged)
    last = valid.groupBy("id").agg(*[
        F.max(F.when(name == f.name, F.struct("seq", "value"))).alias(f"to_{f.name}") for f in columns
    ])
    joined = possessions.join(last, "id", "left")
    snapshot = joined.select("id", *[
        F.when(F.col(f"to_{f.name}").isNotNull(), F.col(f"to_{f.name}.value").try_cast(f.dataType))
        .otherwise(F.col(f.name)).alias(f.name)
        for f in columns
    ])
    return snapshot, refused


def delete(possessions: DataFrame, ids: DataFrame) -> DataFrame:
    return possessions.join(ids.select("id").distinct(), "id", "left_anti")


def log_events(events: DataFrame, possessions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Events to append, with the time defaulting to now, and the events refused with a ``reason``.

    The distinct possessions of the events are looked up, so one that holds most events is looked up once.
    """
    known = events.select("possession_id").distinct().join(
        possessions.select(F.col("id").alias("possession_id")), "possession_id", "left_semi")
    timed = events.withColumn("logged_at", F.coalesce("logged_at", as_of))
    judged = timed.join(known.withColumn("exists", F.lit(True)), "possession_id", "left").withColumn("reason", _reason({
        "not_null:possession_id": F.col("possession_id").isNull(),
        "not_null:event_type": F.col("event_type").isNull(),
        "enum:event_type": ~F.col("event_type").isin(*EVENT_TYPES),
        "foreign_key:possession_id": F.col("exists").isNull(),
    })).drop("exists")
    valid, refused = _split(judged)
    return conform(valid, CONSUMPTION_LOG), refused.select(*events.columns, "reason")


def replenished_days(log: DataFrame) -> DataFrame:
    """Last day a possession was opened or replaced. Works on a stream too."""
    return (
        log.filter(F.col("event_type").isin(*REPLENISHING))
        .groupBy("possession_id")
        .agg(F.max(F.to_date("logged_at")).alias("replenished_on"))
    )


def apply_events(possessions: DataFrame, log: DataFrame) -> DataFrame:
    """Opened and replaced items count as replenished on the event's day; other events change nothing."""
    days = replenished_days(log).withColumnRenamed("possession_id", "id")
    return (
        possessions.join(days, "id", "left")
        .withColumn("last_replenished", F.coalesce("replenished_on", "last_replenished"))
        .select(*possessions.columns)
    )


def latest_status(log: DataFrame) -> DataFrame:
    """Latest event of each possession. Works on a stream too."""
    latest = F.max(F.struct("logged_at", "id", "event_type"))
    return log.groupBy("possession_id").agg(latest.alias("latest")).select(
        "possession_id", F.col("latest.event_type").alias("event_type"), F.col("latest.logged_at").alias("logged_at")
    )
