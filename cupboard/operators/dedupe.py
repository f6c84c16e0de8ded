"""Duplicate suppression as set operations that keep the first row of each key.

"First of key" is ``row_number() = 1``: Spark keeps one row per key in every map task before the
shuffle, so a key that holds a third of all rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cupboard.session import write_and_reload

# The most telling column leads: sorting compares the first column's prefix before anything else.
ORDER_KEY = ("order_id", "source")
COMPOSITE_KEY = ("item_name", "purchase_date", "price", "source")


def first_of_key(rows: DataFrame, keys: tuple[str, ...], order: Sequence[str | Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def first_new_of_key(rows: DataFrame, seen: DataFrame, keys: tuple[str, ...], order: Sequence[str]) -> DataFrame:
    """First row of each key, without the keys in ``seen``. NULL keys must be kept out by the caller.

    Seen keys enter the same grouping as rows that sort before all others, so one shuffle does both.
    """
    pool = rows.withColumn("_seen", F.lit(0)).unionByName(
        seen.select(*keys).withColumn("_seen", F.lit(-1)), allowMissingColumns=True
    )
    return first_of_key(pool, keys, ["_seen", *order]).filter("_seen = 0").drop("_seen")


def is_blank(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit("")) == ""


def drop_empty(rows: DataFrame) -> DataFrame:
    """Drop rows with neither item nor price; they count in no statistic."""
    return rows.filter(~(is_blank("item_name") & F.col("price").isNull()))


def _in_batch(target: DataFrame, batch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Target rows whose keys occur in the batch; a small key set is broadcast by its measured size."""
    return target.join(batch.select(*keys).distinct(), list(keys), "left_semi")


def without_seen(rows: DataFrame, seen: DataFrame, *key_sets: tuple[str, ...]) -> DataFrame:
    """Rows of which no key occurs in ``seen``, in any of the key sets; NULL keys match nothing.

    Every key set is looked up for all rows, so that a join that leaves rows out is not made again for the next one.
    """
    new = rows
    for keys in key_sets:
        hits = _in_batch(seen.select(*keys), rows, keys).distinct()
        new = new.join(hits, list(keys), "left_anti")
    return new


def _order_firsts(rows: DataFrame, target: DataFrame | None, order: Sequence[str]) -> DataFrame:
    with_id = rows.filter(~is_blank("order_id"))
    if target is None:
        return first_of_key(with_id, ORDER_KEY, order)
    seen = _in_batch(target.filter(~is_blank("order_id")).select(*ORDER_KEY), with_id, ORDER_KEY)
    return first_new_of_key(with_id, seen, ORDER_KEY, order)


def accept_by_order(rows: DataFrame, target: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """Order-id rule alone (dedicated shop importers): rows without an order id always pass."""
    return _order_firsts(rows, target, order).unionByName(rows.filter(is_blank("order_id")))


def accept_new(rows: DataFrame, target: DataFrame | None, order: Sequence[str]) -> DataFrame:
    """Rows a first-wins sequential load would insert; ``order`` names the columns that order the rows.

    * order id present: first row of (source, order id) not in the target;
    * no order id, but item, date and price: first row of the composite key among the rows without an
      order id, the rows accepted above, and the target;
    * no order id and a part of the composite key missing: always accepted, since NULL equals nothing.
    """
    # Written: the first rule's winners go into the second rule and into the result.
    by_order = write_and_reload(_order_firsts(rows, target, order))
    no_id = rows.filter(is_blank("order_id"))
    comparable = ~is_blank("item_name") & F.col("purchase_date").isNotNull() & F.col("price").isNotNull()
    keyed = no_id.filter(comparable)
    always = no_id.filter(~comparable)

    stored = []
    if target is not None:
        near = _in_batch(target.filter(comparable).select(*COMPOSITE_KEY), keyed, ("source", "purchase_date"))
        stored = [near.select(*COMPOSITE_KEY, F.lit(-1).alias("_origin"))]
    earlier_orders = by_order.filter(comparable).withColumn("_origin", F.lit(1))
    pool = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [
            keyed.withColumn("_origin", F.lit(0)),
            # Payload columns stay out of the comparison rows; only key and order travel.
            earlier_orders.select(*COMPOSITE_KEY, *[c for c in order if c not in COMPOSITE_KEY], "_origin"),
            *stored,
        ],
    )
    rank = [F.col("_origin") != -1, *order]
    by_composite = first_of_key(pool, COMPOSITE_KEY, rank).filter("_origin = 0").drop("_origin")
    return by_order.unionByName(by_composite).unionByName(always)


def accept_possessions(rows: DataFrame, target: DataFrame, order: Sequence[str]) -> DataFrame:
    """Possessions new by (name, category), first wins, also within the batch."""
    keys = ("name", "category")
    return first_new_of_key(rows, _in_batch(target.select(*keys), rows, keys), keys, order)
