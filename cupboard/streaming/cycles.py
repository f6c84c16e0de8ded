"""What consumables need, kept as a stream: cycles learned from the log and timers for the days at which a mark is due."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cupboard.plans.analytics import CLOSING
from cupboard.schemas import ALERT_THRESHOLD

from .stateful import keep_state

DAY = 86_400_000_000  # microseconds
POSSESSION = "possession"  # the change that tells of a consumable and its lifespan


@dataclass(frozen=True)
class Mark:
    """Stands from ``share`` of the cycle after the last replenishment (whole days), less ``days_before``."""

    name: str
    share: float
    days_before: int = 0


REPLENISH = Mark("replenish", ALERT_THRESHOLD)
DUE_WEEK = Mark("due_week", 1.0, 7)
EMPTY = Mark("empty", 1.0)

CHANGES = "possession_id long, changed_at timestamp, marks string, last_replenished date, cycle_days double, is_learned boolean"
_OUT = "possession_id long, changed_at long, marks string, last_replenished int, cycle_days double, is_learned boolean"
_FACTS = ("possession_id long, tracked boolean, lifespan int, replenished int, opened long, opened_at decimal(38,0), pairs long, "
          "micros decimal(38,0), passed long, marks string, shown string, wake long")
_EVENTS = "possession_id long, at long, opened long, closed long, replaced boolean"


def _arrays(fields: str) -> str:
    """One array a field: all rows of a bucket are one value of the state store, read and written by one call."""
    return ", ".join(re.sub(r"^(\w+) (.*)$", r"\1 array<\2>", field) for field in fields.split(", "))


@dataclass
class _Facts:
    """What is known of a possession up to ``passed`` (microseconds): counts and sums instead of events."""

    tracked: bool = False
    lifespan: int | None = None
    replenished: int | None = None  # day
    opened: int = 0
    opened_at: int = 0  # sum of the instants of openings
    pairs: int = 0
    micros: int = 0  # sum over the pairs of an opening and a later closing
    passed: int = 0
    marks: str = ""
    shown: str = ""  # the last row given
    wake: int = -1  # millisecond at which something happens next

    def take(self, at: int, opened: int, closed: int, replaced: bool) -> None:
        """Events of one instant; an opening and a closing at the same instant are no pair."""
        self.pairs += self.opened * closed
        self.micros += closed * (self.opened * at - self.opened_at)
        self.opened += opened
        self.opened_at += opened * at
        if replaced:
            self.replenished = at // DAY
        self.passed = at

    def days(self, learned: bool) -> float | None:
        if learned and self.pairs:
            return round(self.micros / self.pairs / DAY, 6)
        return None if self.lifespan is None else float(self.lifespan)


class _Marks(StatefulProcessor):
    """Folds the events of a bucket's possessions in the order of their time, each once the watermark has reached it."""

    def __init__(self, marks: tuple[Mark, ...], learned: bool):
        self.marks, self.learned = marks, learned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _arrays(_FACTS))
        self.waiting = handle.getMapState("waiting", "day int", _arrays(_EVENTS))
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, touched = self._known(), set()
        for frame in rows:
            days: dict[int, dict[tuple, list]] = {}
            columns = (frame[c].tolist() for c in ("possession_id", "unnamed", "change", "lifespan_days", "micros"))
            for possession, unnamed, change, lifespan, at in zip(*columns):
                possession = None if unnamed else possession
                touched.add(possession)
                if change == POSSESSION:
                    facts = known.setdefault(possession, _Facts())
                    facts.tracked, facts.lifespan = True, None if pd.isna(lifespan) else int(lifespan)
                elif change == "opened" or change in CLOSING:
                    self._add(days.setdefault(int(at) // DAY, {}), possession, int(at), change == "opened", change in CLOSING, change == "replaced")
            for day, events in days.items():
                for row in self._of_day(day):
                    self._add(events, *row)
                self._keep_day(day, [(*event, *held) for event, held in events.items()])
        for possession in touched:
            known.setdefault(possession, _Facts())
        yield from self._advance(known, touched, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(self._known(), set(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _known(self) -> dict[int | None, _Facts]:
        if not self.facts.exists():
            return {}
        rows = zip(*self.facts.get())
        return {p: _Facts(*(int(v) if isinstance(v, Decimal) else v for v in values)) for p, *values in rows}

    def _keep(self, known: dict[int | None, _Facts]) -> None:
        rows = [(p, f.tracked, f.lifespan, f.replenished, f.opened, Decimal(f.opened_at), f.pairs, Decimal(f.micros), f.passed, f.marks,
                 f.shown, f.wake) for p, f in known.items()]
        self.facts.update(tuple(map(list, zip(*rows))))

    @staticmethod
    def _add(events: dict[tuple, list], possession, at: int, opened: int, closed: int, replaced: bool) -> None:
        held = events.setdefault((possession, at), [0, 0, False])
        held[0], held[1], held[2] = held[0] + int(opened), held[1] + int(closed), bool(held[2] or replaced)

    def _of_day(self, day: int) -> list[tuple]:
        """The bucket's events of a day that wait for the watermark."""
        return [*zip(*(self.waiting.getValue((day,)) or ()))]

    def _keep_day(self, day: int, rows: list[tuple]) -> None:
        self.waiting.updateValue((day,), tuple(map(list, zip(*rows))))

    def _advance(self, known: dict[int | None, _Facts], touched: set, watermark: int) -> Iterator[pd.DataFrame]:
        """Everything up to the watermark's millisecond happens to the possessions that are touched or whose time has come:
        events, and marks whose time comes between them. What is left waits for the bucket's timer, which fires once the
        watermark has reached it; one set at the watermark would not."""
        now, out = (watermark + 1) * 1000, []
        awake = touched | {p for p, facts in known.items() if 0 <= facts.wake <= watermark}
        first: dict[int | None, int] = {}  # the first event that still waits
        for day in sorted(int(k[0]) for k in self.waiting.keys()):
            if day * DAY >= now and awake <= first.keys():
                break
            rows = sorted(self._of_day(day), key=lambda row: row[1])
            left = [row for row in rows if row[1] >= now]
            for possession, at, *event in rows:
                if at < now:
                    facts = known[possession]
                    self._pass(possession, facts, at, out)
                    facts.take(at, *event)
                    self._look(possession, facts, at, out)
                elif possession in awake:
                    first.setdefault(possession, at)
            if not left:
                self.waiting.removeKey((day,))
            elif len(left) < len(rows):
                self._keep_day(day, left)
        for possession in awake:
            facts = known[possession]
            self._pass(possession, facts, now, out)
            facts.passed = max(facts.passed, now - 1)
            self._look(possession, facts, facts.passed, out)  # a new lifespan
            self._wake(facts, first.get(possession))
        if awake:
            self._keep(known)
            self._set_timer(min((f.wake for f in known.values() if f.wake >= 0), default=-1))
        if out:
            columns = dict(zip((c.split()[0] for c in _OUT.split(", ")), zip(*out)))
            types = {"possession_id": "Int64", "last_replenished": "Int64", "cycle_days": "Float64"}  # with NULL and whole
            yield pd.DataFrame({c: pd.array(v, dtype=types[c]) if c in types else list(v) for c, v in columns.items()})

    def _due(self, facts: _Facts) -> list[int]:
        """When each mark is due; none for a possession that is not kept in stock or has no cycle."""
        days = facts.days(self.learned)
        if not facts.tracked or days is None or facts.replenished is None:
            return []
        return [(facts.replenished + floor(round(days * m.share, 6)) - m.days_before) * DAY for m in self.marks]

    def _pass(self, possession, facts: _Facts, until: int, out: list) -> None:
        """Time goes on to just before ``until``."""
        for at in sorted({d for d in self._due(facts) if facts.passed < d < until}):
            self._look(possession, facts, at, out)

    def _look(self, possession, facts: _Facts, at: int, out: list) -> None:
        """A row, if what stands has changed."""
        before, facts.marks = facts.marks, ",".join(m.name for m, due in zip(self.marks, self._due(facts)) if due <= at)
        days = facts.days(self.learned)
        shown = f"{facts.marks} {facts.replenished} {days}"
        if shown != facts.shown and (before or facts.marks):
            out.append((possession, at, facts.marks, facts.replenished, days, self.learned and facts.pairs > 0))
        facts.shown = shown

    def _wake(self, facts: _Facts, first: int | None) -> None:
        """At the first event that waits or the next mark."""
        wake = [d // 1000 for d in self._due(facts) if d > facts.passed]
        if first is not None:
            wake.append(first // 1000)
        facts.wake = min(wake, default=-1)

    def _set_timer(self, wake: int) -> None:
        """One timer a bucket."""
        timer = self.timer.get()[0] if self.timer.exists() else -1
        if wake != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if wake >= 0:
                self.handle.registerTimer(wake)
            self.timer.update((wake,))


def mark_changes(changes: DataFrame, marks: tuple[Mark, ...] = (REPLENISH,), learned: bool = True, buckets: int = 4096) -> DataFrame:
    """Stream of rows (CHANGES) that tell which marks stand for a consumable, one whenever that changes.

    ``changes`` is a stream of (possession_id, change, lifespan_days, at) with a watermark on ``at``. The change ``possession``
    tells of a consumable and its lifespan (NULL: unknown) and counts from its arrival; ``opened``, ``empty`` and ``replaced``
    are events of the log; anything else only lets time go on. A replenishment is a ``replaced``. With ``learned``, the mean
    time over all pairs of an opening and a later closing replaces the lifespan once there is a pair.

    Events count in the order of their time, whatever order they arrive in, once the watermark has reached them; a row at or
    before the watermark is late and left out. A possession holds eleven values and the events the watermark has not reached.

    Calling the processor and its state costs far more than folding an event, so possessions share ``buckets``: one call reads
    and writes what is known of a bucket's possessions, and its events a day at a time; a bucket has one timer. The number of
    buckets stays for the life of a checkpoint; more of them make a task hold less at once.
    """
    keep_state(changes.sparkSession)
    possession = F.col("possession_id").cast("long")
    rows = changes.select(
        F.pmod(F.xxhash64(possession), F.lit(buckets)).alias("_bucket"), F.coalesce(possession, F.lit(0)).alias("possession_id"),
        possession.isNull().alias("unnamed"), "change", F.col("lifespan_days").cast("int").alias("lifespan_days"), F.unix_micros("at").alias("micros"), "at")
    given = rows.groupBy("_bucket").transformWithStateInPandas(_Marks(marks, learned), _OUT, outputMode="Append", timeMode="EventTime")
    return given.select(
        "possession_id", F.timestamp_micros("changed_at").alias("changed_at"), "marks",
        F.date_from_unix_date("last_replenished").alias("last_replenished"), "cycle_days", "is_learned")


def standing(changes: DataFrame) -> DataFrame:
    """The last row of each possession, where a mark stands."""
    last = F.max_by(F.struct(*changes.columns), "changed_at").alias("last")
    return changes.groupBy("possession_id").agg(last).select("last.*").where("marks <> ''")
