"""Streams with state per key: first orders, and alerts that fire when a lifespan runs out without an event."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cupboard.operators.dedupe import ORDER_KEY, is_blank
from cupboard.schemas import ALERT_THRESHOLD

_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> SparkSession:
    """Keyed state needs a store that grows beyond memory; its changes go to the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    return spark


class _FirstRows(StatefulProcessor):
    """Lets the first row of each order key of a bucket pass, once. Of the rows that arrive together it is the smallest by ``order``."""

    def __init__(self, order: list[str], columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getMapState("taken", ", ".join(f"{c} string" for c in ORDER_KEY), "taken boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for order in _order_keys(initialState):
            self.taken.updateValue(order, (True,))

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts = None  # one row a key, however many the key has
        for frame in rows:
            frame = frame if firsts is None else pd.concat([firsts, frame])
            firsts = frame.sort_values(self.order, kind="stable").drop_duplicates([*ORDER_KEY])
        if firsts is None:
            return
        if self.taken.exists():
            firsts = firsts[[not self.taken.containsKey(order) for order in _order_keys(firsts)]]
        for order in _order_keys(firsts):
            self.taken.updateValue(order, (True,))
        if len(firsts):
            yield firsts[self.columns]

    def close(self) -> None:
        pass


def _order_keys(frame: pd.DataFrame) -> list[tuple]:
    return [*zip(*(frame[c] for c in ORDER_KEY))]


def _by_bucket(rows: DataFrame, buckets: int):
    """Calling the processor costs far more than looking up a key, so one call takes the keys of a bucket."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*ORDER_KEY), F.lit(buckets))).groupBy("_bucket")


def first_orders(rows: DataFrame, order: list[str], stored: DataFrame | None = None, buckets: int = 4096) -> DataFrame:
    """Of a stream of purchases, those that the order-id rule accepts: the first row of each (source, order id) that
    neither came before nor is in ``stored``; rows without an order id all pass.

    The keys seen are state of the stream, so no trigger reads the table: a trigger looks up its own keys only. ``stored`` is
    read once, when the query first starts; a restart goes on from the checkpoint, and a replayed trigger gives the same rows.
    The number of ``buckets`` stays for the life of a checkpoint; one task holds a bucket's new keys at a time.
    """
    keep_state(rows.sparkSession)
    with_id = _by_bucket(rows.filter(~is_blank("order_id")), buckets)
    seen = None if stored is None else _by_bucket(stored.filter(~is_blank("order_id")).select(*ORDER_KEY).distinct(), buckets)
    firsts = with_id.transformWithStateInPandas(
        _FirstRows(order, rows.columns), rows.schema, outputMode="Append", timeMode="None", initialState=seen)
    return firsts.unionByName(rows.filter(is_blank("order_id")))


ALERTS = "possession_id long, last_replenished date, alert_on date"


class _RunsOut(StatefulProcessor):
    """Keeps a possession's lifespan and last replenishment, and a timer for the day its alert is due."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lifespan = handle.getValueState("lifespan", "days int")
        self.replenished = handle.getValueState("replenished", "day date")
        self.due = handle.getValueState("due", "at long")  # of the timer, or of the alert that has fired

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lifespan = self.lifespan.get()[0] if self.lifespan.exists() else None
        day = self.replenished.get()[0] if self.replenished.exists() else None
        for frame in rows:
            days = frame["lifespan_days"].dropna()
            if len(days):
                lifespan = int(days.iloc[-1])
            events = frame["replenished_at"].dropna()
            if len(events):
                latest = events.max().date()
                day = latest if day is None else max(day, latest)
        if lifespan is not None:
            self.lifespan.update((lifespan,))
        if day is not None:
            self.replenished.update((day,))
        if lifespan is None or day is None:
            return
        due = self._due(day, lifespan)
        if self.due.exists() and self.due.get()[0] == due:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(int(timer))
        self.due.update((due,))
        if due <= timerValues.getCurrentWatermarkInMs():
            yield self._alert(key, due)  # a timer in the past would not fire
        else:
            self.handle.registerTimer(due)

    def _due(self, day, lifespan: int) -> int:
        start = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
        return int((start + timedelta(days=int(lifespan * self.threshold))).timestamp() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._alert(key, expiredTimerInfo.getExpiryTimeInMs())

    def _alert(self, key, due: int) -> pd.DataFrame:
        alert_on = datetime.fromtimestamp(due / 1000, timezone.utc).date()
        return pd.DataFrame({"possession_id": [key[0]], "last_replenished": [self.replenished.get()[0]], "alert_on": [alert_on]})

    def close(self) -> None:
        pass


def lifespan_alerts(changes: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Alerts (ALERTS) of consumables that have gone ``threshold`` of their lifespan without being replenished.

    ``changes`` is a stream of (possession_id, lifespan_days, replenished_at, seen_at) with a watermark on ``seen_at``: a
    row sets the lifespan, tells of a replenishment, or, with neither, only lets time go on. An alert fires when the
    watermark passes its day; a replenishment before that moves it, one after it starts the next. A row seen at or before the watermark is late and is left out. A possession holds three
    values and one timer, whatever the number of its events.
    """
    keep_state(changes.sparkSession)
    rows = changes.select(
        F.col("possession_id").cast("long").alias("possession_id"), F.col("lifespan_days").cast("int").alias("lifespan_days"), "replenished_at", "seen_at")
    return rows.groupBy("possession_id").transformWithStateInPandas(
        _RunsOut(threshold), ALERTS, outputMode="Append", timeMode="EventTime")


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream of new rows over everything available and return all rows it has given so far. The sink's log keeps a
    replayed trigger from being seen twice."""
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
