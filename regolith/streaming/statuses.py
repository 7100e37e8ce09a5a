"""Statuses as a stream: state by identity, timers for what decay alone will change.

For each identity the state is its decayed sums by event type and the events of days that are not over. A timer stands at the end
of the first day on which an event counts or the status changes without one; when the watermark passes it, the days up to it are
settled in order. What comes out, in append mode, are changes only: (ubid, on_date, status, score). An identity is Dormant
with score 0 before its first change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from regolith.operators.activity import ACTIVE_FROM, DORMANT_FROM

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGES = "ubid long, day int, status string, score double"
_DAY = 86_400_000
#: Half-lives after which a status is taken to stay: less than a millionth is left of any sum.
SETTLED = 20


def status_of(score: float) -> str:
    return "Active" if score >= ACTIVE_FROM else "Dormant" if score >= DORMANT_FROM else "Closed"


class Sums:
    """Decayed sums by half-life at a day, and when the status that they give changes."""

    def __init__(self, day: int, sums: dict[float, float]):
        self.day, self.sums = day, sums

    def at(self, days: np.ndarray) -> np.ndarray:
        """Scores on later days."""
        total = np.zeros(len(days))
        for half_life, s in self.sums.items():
            total += s if half_life <= 0 else s * np.exp(-np.log(2.0) * (days - self.day) / half_life)
        return total

    def move(self, day: int) -> None:
        for h in self.sums:
            if h > 0:
                self.sums[h] *= float(np.exp(-np.log(2.0) * (day - self.day) / h))
        self.day = day

    def change(self, status: str, before: int | None = None) -> int | None:
        """The first later day, before the one given, on which decay alone makes the status another."""
        last = self.day + int(SETTLED * max([0.0, *self.sums]))
        days = np.arange(self.day + 1, (last if before is None else min(last, before - 1)) + 1)
        scores = self.at(days)
        names = np.where(scores >= ACTIVE_FROM, "Active", np.where(scores >= DORMANT_FROM, "Dormant", "Closed"))
        at = np.flatnonzero(names != status)
        return int(days[at[0]]) if len(at) else None


def settle(sums: Sums, status: str, pending: dict[int, dict[float, float]], upto: int) -> tuple[str, list[tuple[int, str, float]]]:
    """Take the pending days up to `upto` into the sums; returns the status then and its changes in order."""
    out = []
    days = sorted(d for d in pending if d <= upto)
    for day in [*days, None]:
        while (on := sums.change(status, day if day is not None else upto + 1)) is not None:
            sums.move(on)
            score = float(sums.at(np.array([on]))[0])
            status = status_of(score)
            out.append((on, status, score))
        if day is not None:
            sums.move(day)
            for h, w in pending.pop(day).items():
                sums.sums[h] = sums.sums.get(h, 0.0) + w
            score = float(sums.at(np.array([day]))[0])
            if status_of(score) != status:
                status = status_of(score)
                out.append((day, status, score))
    return status, out


class Statuses(StatefulProcessor):
    """State: the settled day, sums and status of an identity, and weights by day and half-life of days that are not settled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "day int, status string, half_lives array<double>, sums array<double>")
        self.pending = handle.getMapState("pending", "day int, half_life double", "weight double")

    def _load(self) -> tuple[Sums, str]:
        got = self.settled.get()
        if got is None:
            return Sums(-(10**6), {}), status_of(0.0)
        return Sums(got[0], dict(zip(got[2], got[3]))), got[1]

    def _timer(self, sums: Sums, status: str, days: list[int]) -> None:
        """One timer, at the end of the next day on which something happens."""
        nearest = [*days, *([x] if (x := sums.change(status, min(days, default=None))) is not None else [])]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if nearest:
            self.handle.registerTimer((min(nearest) + 1) * _DAY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums, status = self._load()
        new = pd.concat(rows)
        for (day, half_life), w in new.groupby(["day", "half_life"])["weight"].sum().items():
            if day > sums.day:  # events of settled days are too late
                at = (int(day), float(half_life))
                held = self.pending.getValue(at) if self.pending.containsKey(at) else None
                self.pending.updateValue(at, (float(w) + (held[0] if held else 0.0),))
        self._timer(sums, status, sorted({k[0] for k in self.pending.keys()}))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sums, status = self._load()
        upto = timerValues.getCurrentWatermarkInMs() // _DAY - 1  # the last day that is over
        pending: dict[int, dict[float, float]] = {}
        for (day, half_life), (w,) in list(self.pending.iterator()):
            if day <= upto:
                pending.setdefault(day, {})[half_life] = w
                self.pending.removeKey((day, half_life))
        status, changes = settle(sums, status, pending, upto)
        sums.move(upto)
        self.settled.update((upto, status, list(sums.sums), list(sums.sums.values())))
        self._timer(sums, status, sorted({k[0] for k in self.pending.keys()}))
        if changes:
            days, names, scores = zip(*changes)
            yield pd.DataFrame({"ubid": np.full(len(days), key[0], np.int64), "day": np.array(days, np.int32), "status": list(names), "score": np.round(scores, 4)})

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, taxonomy: DataFrame, delay: str) -> DataFrame:
    """From a stream of (ubid, event_type, event_date) to the changes of status, each once the watermark has passed its day.

    Events may be `delay` late; later ones are dropped. Runs on the RocksDB state store.
    """
    events.sparkSession.conf.set(PROVIDER, ROCKSDB)
    known = taxonomy.filter("is_active").select(F.col("event_type").alias("_type"), F.col("weight").cast("double").alias("weight"), F.col("half_life").cast("double").alias("half_life"))
    e = events.filter("ubid is not null and event_date is not null").withColumn("at", F.to_date("event_date").cast("timestamp")).withWatermark("at", delay)
    e = e.join(known, F.lower("event_type") == F.col("_type"))
    day = F.datediff(F.col("at").cast("date"), F.lit("1970-01-01").cast("date")).alias("day")
    rows = e.select(F.col("ubid").cast("long").alias("ubid"), day, "half_life", "weight", "at")
    found = rows.groupBy("ubid").transformWithStateInPandas(Statuses(), _CHANGES, "append", "eventtime")
    return found.select("ubid", F.date_from_unix_date("day").alias("on_date"), "status", "score")


def on(changes: DataFrame, identities: DataFrame, date: str) -> DataFrame:
    """(ubid, status) of all identities at a date, from the changes until then."""
    last = changes.filter(F.col("on_date") <= F.lit(date).cast("date")).groupBy("ubid").agg(F.max_by("status", "on_date").alias("status"))
    return identities.select("ubid").join(last, "ubid", "left").select("ubid", F.coalesce("status", F.lit(status_of(0.0))).alias("status"))
