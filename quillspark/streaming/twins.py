"""Continuous forms of the stateful operators, for streams: state by key, late rows by watermark.

Each gives over a finished stream what its batch form gives over the table, as long as rows of a key arrive in the order of
their times; what is later than the watermark is left out, which the batch form has no need of.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stateful import DAILY, DAY_MICROS, SHARE, wait_after


def rate_counts(requests: DataFrame, client: str, ts: str, seconds: int = 60, most: int = 20, late: str = "10 minutes") -> DataFrame:
    """(client, start, n, refused) of each time slice of a client, once the watermark has passed it."""
    slices = requests.withWatermark(ts, late).groupBy(client, F.window(ts, f"{seconds} seconds").alias("w"))
    return slices.agg(F.count("*").alias("n")).select(client, F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def session_counts(events: DataFrame, who: str, ts: str, minutes: int = 15, late: str = "10 minutes") -> DataFrame:
    """(who, started, n) of each session, once it is over: a pause of exactly ``minutes`` ends one, so windows are a microsecond shorter."""
    gap = f"{minutes * 60_000_000 - 1} microseconds"
    return events.withWatermark(ts, late).groupBy(who, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("started"), "n")


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows that a key has in a micro-batch, in order."""
    return pd.concat(list(batches)).sort_values(by, kind="stable")


def daily_budget(requests: DataFrame, limit: int = int(DAILY * SHARE)) -> DataFrame:
    """(id, day, before, allowed) from (id, ts, units): the state of a day is what it has spent; a refused request adds nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows, out = _ordered(batches, ["ts", "id"]), []
        for i, n in zip(rows["id"], rows["units"], strict=True):
            if n < 0:
                raise ValueError("units must not be negative")
            out.append((i, key[0], spent, spent < limit))
            spent += int(n) if spent < limit else 0
        state.update((spent,))
        yield pd.DataFrame(out, columns=["id", "day", "before", "allowed"])

    return requests.withColumn("day", F.to_date("ts")).groupBy("day").applyInPandasWithState(step, "id long, day date, before long, allowed boolean", "spent long", "append", GroupStateTimeout.NoTimeout)


def marks(readings: DataFrame, cap_days: float = 365, late_hours: float = 24) -> DataFrame:
    """(who, step, mark, late) from (who, step, micros): the state is the mark, which never goes back and goes forward by the cap at most."""
    cap, late = int(cap_days * DAY_MICROS), int(late_hours * 3_600_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else None
        rows, out = _ordered(batches, ["step"]), []
        for n, now in zip(rows["step"], rows["micros"], strict=True):
            mark = int(now) if mark is None else max(mark, min(int(now), mark + cap))
            out.append((key[0], n, mark, mark - int(now) > late))
        state.update((mark,))
        yield pd.DataFrame(out, columns=["who", "step", "mark", "late"])

    return readings.groupBy("who").applyInPandasWithState(step, "who long, step long, mark long, late boolean", "mark long", "append", GroupStateTimeout.NoTimeout)


def back_off(tries: DataFrame) -> DataFrame:
    """(who, step, failures, wait) from (who, step, failed): the state is how many tries in a row have failed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows, out = _ordered(batches, ["step"]), []
        for n, failed in zip(rows["step"], rows["failed"], strict=True):
            run = run + 1 if failed else 0
            out.append((key[0], n, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["who", "step", "failures"])

    found = tries.groupBy("who").applyInPandasWithState(step, "who long, step long, failures long", "run long", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("wait", wait_after(F.col("failures")))
