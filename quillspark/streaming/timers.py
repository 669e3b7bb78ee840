"""Stateful streams in the order of event time: rows wait until the watermark has passed them, timers act where nothing comes, and
state goes when its time is over.

Rows may come in any order within the watermark's delay. A key keeps them until a timer of its own fires, which is when no earlier
row can come any more; so each operator gives what its batch form gives over the table, whatever the micro-batches were. Rows later
than the watermark are left out. The store must be RocksDB (``with_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.stateful import DAILY, DAY_MICROS, SHARE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class InOrder(StatefulProcessor):
    """Holds the rows of a key by (micros, tie) and passes them on in order, once the watermark is behind them."""

    pending_value = "x long"
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "micros long, tie long", self.pending_value)

    def held(self, row: Row) -> tuple:
        """What is kept of a row."""
        return (0,)

    def passed(self, key: tuple, upto: int, rows: list[tuple[int, int, tuple]]) -> list[tuple]:
        """Results for the rows up to ``upto`` (microseconds), in order."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        timers = set()
        for r in rows:
            self.pending.updateValue((r["micros"], r["tie"]), self.held(r))
            timers.add(r["micros"] // 1000 + 1)
        for t in timers:
            self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        # all that the watermark has passed, not this timer's alone: timers set from here on fire with the next micro-batch
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        due = sorted((k[0], k[1], tuple(v)) for k, v in self.pending.iterator() if k[0] < upto)
        for micros, tie, _ in due:
            self.pending.removeKey((micros, tie))
        yield from (Row(**dict(zip(self.columns, x, strict=True))) for x in self.passed(key, upto, due))

    def close(self) -> None:
        pass


class Idle(InOrder):
    """Tells once of each quiet spell, when it has lasted ``micros`` microseconds; the next row begins a new one."""

    columns = ("who", "since", "fired")

    def __init__(self, micros: int) -> None:
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "micros long, fired boolean")

    def passed(self, key, upto, rows):
        last, fired = self.last.get() if self.last.exists() else (None, False)
        out, before = [], (last, fired)
        for micros, _, _ in rows:
            if last is not None and micros - last >= self.micros and not fired:
                out.append((key[0], last, last + self.micros))
            last, fired = micros, False
        if last is not None and not fired and last + self.micros < upto:
            out.append((key[0], last, last + self.micros))
            fired = True
        if (last, fired) != before:
            self.last.update((last, fired))
            if not fired:
                self.handle.registerTimer((last + self.micros) // 1000 + 1)
        return out


class Budget(InOrder):
    """Units of a day, first come first served; a refused request takes none. The day's state goes a day after it has ended."""

    pending_value = "units long"
    columns = ("tie", "day", "before", "allowed")

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.spent = handle.getValueState("spent", "units long")

    def held(self, row):
        if row["units"] < 0:
            raise ValueError("units must not be negative")
        return (row["units"],)

    def handleInputRows(self, key, rows, timerValues):
        self.handle.registerTimer((key[0] + 2) * DAY_MICROS // 1000)
        return super().handleInputRows(key, rows, timerValues)

    def passed(self, key, upto, rows):
        spent, out = self.spent.get()[0] if self.spent.exists() else 0, []
        for _, tie, (units,) in rows:
            out.append((tie, key[0], spent, spent < self.limit))
            spent += units if spent < self.limit else 0
        if upto >= (key[0] + 2) * DAY_MICROS:
            self.spent.clear()
            self.pending.clear()
        elif rows:
            self.spent.update((spent,))
        return out


class Writes(InOrder):
    """Optimistic writes to one record of tasks: a write counts if its generation is the record's, which then goes up by one; its
    fields go into its task's, a null one takes the field away. Keeps each task's fields under their own key."""

    pending_value = "generation long, task string, field string, value string"
    columns = ("key", "tie", "taken", "generation", "task", "field", "value")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.generation = handle.getValueState("generation", "generation long")
        self.fields = handle.getMapState("fields", "task string, field string", "value string")

    def held(self, row):
        return (row["generation"], row["task"], row["field"], row["value"])

    def passed(self, key, upto, rows):
        now, out = self.generation.get()[0] if self.generation.exists() else 0, []
        for _, tie, (generation, task, field, value) in rows:
            taken = generation == now
            if taken:
                now += 1
                if value is not None:
                    self.fields.updateValue((task, field), (value,))
                elif self.fields.containsKey((task, field)):
                    self.fields.removeKey((task, field))
            held = self.fields.getValue((task, field))[0] if self.fields.containsKey((task, field)) else None
            out.append((key[0], tie, taken, now, task, field, held))
        if rows:
            self.generation.update((now,))
        return out


def _in_time(rows: DataFrame, ts: str, late: str) -> DataFrame:
    return rows.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).withColumn("micros", F.unix_micros("_ts"))


def idle_spells(events: DataFrame, who: str, ts: str, tie: str, minutes: float = 15, late: str = "10 minutes") -> DataFrame:
    """(who, since, fired) in microseconds: each quiet spell of ``minutes`` or longer, once."""
    rows = _in_time(events, ts, late).select(F.col(who).cast("long").alias("who"), "_ts", "micros", F.col(tie).cast("long").alias("tie"))
    return rows.groupBy("who").transformWithState(Idle(int(minutes * 60_000_000)), "who long, since long, fired long", "append", "eventTime")


def daily_budget(requests: DataFrame, ts: str, tie: str, units: str, limit: int = int(DAILY * SHARE), late: str = "10 minutes") -> DataFrame:
    """(tie, day, before, allowed): day is a number of days since 1970."""
    rows = _in_time(requests, ts, late).select("_ts", "micros", F.col(tie).cast("long").alias("tie"), F.col(units).cast("long").alias("units"), F.unix_date(F.to_date("_ts")).cast("long").alias("day"))
    return rows.groupBy("day").transformWithState(Budget(limit), "tie long, day long, before long, allowed boolean", "append", "eventTime")


def merged_writes(writes: DataFrame, key: str, ts: str, tie: str, late: str = "10 minutes") -> DataFrame:
    """(key, tie, taken, generation, task, field, value) for each write (key, ts, tie, generation, task, field, value): whether it counts, and
    the record's generation and the field's value after it."""
    rows = _in_time(writes, ts, late).select(F.col(key).cast("long").alias("key"), "_ts", "micros", F.col(tie).cast("long").alias("tie"), F.col("generation").cast("long").alias("generation"), "task", "field", "value")
    return rows.groupBy("key").transformWithState(Writes(), "key long, tie long, taken boolean, generation long, task string, field string, value string", "append", "eventTime")
