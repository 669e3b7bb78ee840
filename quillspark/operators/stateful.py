"""Operators that carry something from row to row, in batch form; ``streaming.twins`` has the continuous ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Units of a day, and the share of them at which the day's budget counts as spent. Fixed values.
DAILY, SHARE = 10_000, 0.65
#: Seconds to wait after so many failures in a row; three are free. Fixed values.
WAITS = {4: 30, 5: 60, 6: 300}
LONGEST_WAIT = 900
DAY_MICROS = 86_400_000_000


def sum_before(df: DataFrame, by: str, ts: str, tie: str, value: str, seconds: int = 60) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the earlier rows of the group. Sums of time slices add up first, so that a
    group of any size is spread over as many tasks as it has slices. A null group is a group, rows without a time come first."""
    cut = df.withColumn("_slice", F.floor(F.unix_timestamp(ts) / seconds))
    sums = cut.groupBy(by, "_slice").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(by, "_slice").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(F.col(by).alias("_by"), F.col("_slice").alias("_at"), "_start")
    out = cut.join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_slice").eqNullSafe(F.col("_at")))
    return out.withColumn("before", F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_slice", "_start", "_by", "_at")


def within_daily_budget(requests: DataFrame, ts: str, tie: str, units: str, limit: int = int(DAILY * SHARE)) -> DataFrame:
    """Adds day, before (units reserved earlier that UTC day) and allowed. A refused request adds nothing, and as units are
    never negative all later ones are refused too, so the sum over all earlier rows decides. Negative units are an error."""
    fine = F.when(F.col(units) < 0, F.raise_error(F.lit("units must not be negative"))).otherwise(F.col(units))
    dated = requests.withColumn("day", F.to_date(ts)).withColumn(units, fine)
    return sum_before(dated, "day", ts, tie, units).withColumn("allowed", F.col("before") < limit)


def rate_limited(requests: DataFrame, client: str, ts: str, tie: str, seconds: int = 60, most: int = 20) -> DataFrame:
    """Adds allowed: whether a request is among the first ``most`` of its client's time slice of ``seconds``."""
    slices = requests.withColumn("_slice", F.floor(F.unix_timestamp(ts) / seconds))
    nth = F.row_number().over(Window.partitionBy(client, "_slice").orderBy(ts, tie))
    return slices.withColumn("allowed", nth <= most).drop("_slice")


def sessions(events: DataFrame, who: str, ts: str, tie: str, minutes: float = 15) -> DataFrame:
    """(who, session, started, ended, n) in microseconds: a pause of ``minutes`` or longer ends a session."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    order = Window.partitionBy(who).orderBy(ts, tie)
    new = F.coalesce(at - F.lag(at).over(order) >= int(minutes * 60_000_000), F.lit(True))
    numbered = events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(order))
    return numbered.groupBy(who, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))


def idle_spells(events: DataFrame, who: str, ts: str, minutes: float = 15, until: int | None = None) -> DataFrame:
    """(who, since, fired) in microseconds: each pause of ``minutes`` or longer after an activity, once; the one after the last activity if it
    lasts up to ``until`` (microseconds; without it, for ever)."""
    pause = int(minutes * 60_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(F.col(who).alias("who"), at.alias("since")).where("since IS NOT NULL").distinct()
    following = F.lead("since").over(Window.partitionBy("who").orderBy("since"))
    ends = F.coalesce(following, F.lit(until).cast("long"), F.lit((1 << 63) - 1))
    return rows.withColumn("_next", ends).where(F.col("_next") - F.col("since") >= pause).select(F.col("who").alias(who), "since", (F.col("since") + pause).alias("fired"))


def marks(readings: DataFrame, who: str, order: str, ts: str, cap_days: float = 365, late_hours: float = 24) -> DataFrame:
    """(who, order, mark, late): the mark that never goes back and goes forward by ``cap_days`` a step at most, and whether
    the reading is more than ``late_hours`` behind it. Each step needs the one before; rows stream through in order, so a
    task holds one mark and one batch whatever a group's size."""
    cap, late = int(cap_days * DAY_MICROS), int(late_hours * 3_600_000_000)
    rows = readings.select(F.col(who).alias("who"), F.col(order).alias("step"), F.unix_micros(F.col(ts).cast("timestamp")).alias("now"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = mark = None
        for batch in batches:
            out, flags = [], []
            for w, now in zip(batch.column("who").to_pylist(), batch.column("now").to_pylist(), strict=True):
                mark, at = (now if w != at or mark is None else mark if now is None else max(mark, min(now, mark + cap))), w
                out.append(mark)
                flags.append(None if now is None else mark - now > late)
            yield pa.RecordBatch.from_arrays([batch.column("who"), batch.column("step"), pa.array(out, pa.int64()), pa.array(flags, pa.bool_())], names=["who", "step", "mark", "late"])

    types = dict(rows.dtypes)
    ordered = rows.repartition("who").sortWithinPartitions("who", "step")
    return ordered.mapInArrow(run, f"who {types['who']}, step {types['step']}, mark long, late boolean").toDF(who, order, "mark", "late")


def wait_after(failures: Column) -> Column:
    """Seconds to wait after ``failures`` wrong tries in a row."""
    out = F.when(failures < min(WAITS), 0)
    for n, seconds in WAITS.items():
        out = out.when(failures == n, seconds)
    return out.otherwise(LONGEST_WAIT).cast("long")


def failures_in_a_row(tries: DataFrame, who: str, order: str, failed: Column) -> DataFrame:
    """Adds failures (how many in a row up to this row; 0 after a success) and wait."""
    w = Window.partitionBy(who).orderBy(order)
    run = tries.withColumn("_failed", F.coalesce(failed, F.lit(False))).withColumn("_run", F.sum((~F.col("_failed")).cast("int")).over(w))
    inside = Window.partitionBy(who, "_run").orderBy(order)
    out = run.withColumn("failures", F.sum(F.col("_failed").cast("int")).over(inside).cast("long"))
    return out.withColumn("wait", wait_after(F.col("failures"))).drop("_failed", "_run")


def latest(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """The row of the greatest generation for each key; combined before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, generation).alias("_r")).select("_r.*")


def reachable(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): what the entries (node) reach over the edges (src, dst), themselves included. A round for each step of the
    longest way; each frontier is a table in the shared folder, and every eighth round so is all that is seen, so plans stay
    short."""
    seen = frontier = staged(entries.select("node").distinct(), "reach")
    rounds = 0
    while True:
        ahead = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = staged(ahead.join(seen, "node", "left_anti"), "reach")
        if frontier.isEmpty():
            return seen
        rounds += 1
        seen = seen.unionByName(frontier)
        seen = staged(seen, "reach-seen") if rounds % 8 == 0 else seen


def split_by_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, reached) of the nodes (node, entry, file): whether a file is reached from an entry over the edges (src, dst); a file that
    several nodes have is reached if one is. Raises for an edge whose target isn't a node."""
    lost = missing_targets(nodes, edges).limit(1).count()
    if lost:
        raise ValueError("an edge leads to no node")
    found = reachable(nodes.where("entry").select("node"), edges).withColumn("_hit", F.lit(1))
    return nodes.join(found, "node", "left").groupBy("file").agg(F.coalesce(F.max("_hit"), F.lit(0)).cast("boolean").alias("reached"))


def written(state: DataFrame, writes: DataFrame) -> DataFrame:
    """Optimistic writes: (key, generation, value, conflict) from the state (key, generation, value) and writes (key, generation, value),
    at most one taken for each key: a write counts if its generation is the state's (0 for a new key), of several the least
    value; then the generation goes up by one. conflict tells whether a write of the key came too late or lost."""
    now = state.select("key", F.col("generation").alias("_g"), F.col("value").alias("_v"))
    joined = writes.join(now, "key", "full")
    fits = F.col("generation") == F.coalesce("_g", F.lit(0))
    out = joined.groupBy("key").agg(F.max("_g").alias("_g"), F.max("_v").alias("_v"), F.min(F.when(fits, F.col("value"))).alias("_new"), F.count_if(F.col("generation").isNotNull()).alias("_n"), F.count_if(fits).alias("_ok"))
    taken = F.col("_ok") > 0
    return out.select("key", (F.coalesce("_g", F.lit(0)) + taken.cast("int")).cast("long").alias("generation"), F.when(taken, F.col("_new")).otherwise(F.col("_v")).alias("value"), (F.col("_n") > taken.cast("int")).alias("conflict"))


def merged_writes(writes: DataFrame, state: DataFrame, width: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Replays optimistic writes (key, tie, generation, task, field, value) to the records (key, generation) in the order of ``tie`` within
    a key: a write is taken if its generation is the record's (0 for a new key), which then goes up by one. Gives (key, tie, taken, after) for each
    write, and (key, generation, task, field, value) of what the taken writes leave: of each field the last one, nothing for a null.

    A stretch of ``width`` ties of a key is a map from the generation before it to the one after it, which leaves all generations but
    its writes' own as they are. Such maps are composed pair by pair up a tree; from its top the generation before each stretch comes
    down again. So no task has more of a key than one stretch, and the tree's depth is the logarithm of the stretches."""
    types = dict(writes.dtypes)
    least = writes.agg(F.min("tie")).first()[0] or 0
    cut = staged(writes.withColumn("_s", F.floor((F.col("tie") - least) / width)), "writes")
    known = state.groupBy("key").agg(F.max("generation").alias("_g"))

    def by_stretch(work, more: str = ""):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, rows = None, []
            for batch in batches:
                for row in batch.to_pylist():
                    if (row["key"], row["_s"]) != at and rows:
                        yield work(rows)
                        rows = []
                    at = (row["key"], row["_s"])
                    rows.append(row)
            if rows:
                yield work(rows)

        return run

    def as_map(rows: list[dict]) -> pa.RecordBatch:
        after: dict[int, int] = {}
        for row in reversed(rows):
            if row["generation"] is not None:
                after[row["generation"]] = after.get(row["generation"] + 1, row["generation"] + 1)
        n = len(after)
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["key"]] * n, key_type), pa.array([rows[0]["_s"]] * n, pa.int64()), pa.array(list(after), pa.int64()), pa.array(list(after.values()), pa.int64())], names=["key", "node", "g", "h"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(writes.schema["key"].dataType)
    dealt = cut.select("key", "_s", "tie", "generation").repartition("key", "_s").sortWithinPartitions("key", "_s", "tie")
    levels = [staged(dealt.mapInArrow(by_stretch(as_map), f"key {types['key']}, node long, g long, h long"), "writes-maps")]
    top = cut.agg(F.max("_s")).first()[0] or 0
    while top > 0:
        below = levels[-1].withColumn("up", F.floor(F.col("node") / 2))
        left, right = below.where("pmod(node, 2) = 0"), below.where("pmod(node, 2) = 1")
        go_on = right.select(F.col("key").alias("k"), F.col("up").alias("u"), F.col("g").alias("h"), F.col("h").alias("then"))
        through = left.join(go_on, (left["key"].eqNullSafe(go_on["k"])) & (left["up"] == go_on["u"]) & (left["h"] == go_on["h"]), "left").select(left["key"], left["up"], left["g"], F.coalesce("then", left["h"]).alias("h"))
        first = left.select(F.col("key").alias("k"), F.col("up").alias("u"), F.col("g").alias("g2"))
        alone = right.join(first, right["key"].eqNullSafe(first["k"]) & (right["up"] == first["u"]) & (right["g"] == first["g2"]), "left_anti").select("key", "up", "g", "h")
        levels.append(staged(through.unionByName(alone).withColumnRenamed("up", "node"), "writes-maps"))
        top //= 2
    # the generation before each stretch, from the top down
    nodes = cut.select("key", F.col("_s").alias("node")).distinct()
    tops = nodes.select("key").distinct().join(known.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left").select("key", F.lit(0).cast("long").alias("node"), F.coalesce("_g", F.lit(0)).alias("start"))
    start = staged(tops, "writes-starts")
    for d in range(len(levels) - 2, -1, -1):
        here = staged(nodes.select("key", F.floor(F.col("node") / (1 << d)).alias("node")).distinct(), "writes-nodes") if d else nodes
        parent = start.select(F.col("key").alias("k"), F.col("node").alias("u"), "start")
        own = here.join(parent, here["key"].eqNullSafe(parent["k"]) & (F.floor(here["node"] / 2) == parent["u"])).select("key", "node", "start")
        lefts = levels[d].where("pmod(node, 2) = 0").select(F.col("key").alias("k"), (F.col("node") + 1).alias("n"), F.col("g").alias("s"), "h")
        start = own.join(lefts, own["key"].eqNullSafe(lefts["k"]) & (own["node"] == lefts["n"]) & (own["start"] == lefts["s"]), "left").select("key", "node", F.coalesce("h", "start").alias("start"))
        start = staged(start, "writes-starts")

    def verdicts(rows: list[dict]) -> pa.RecordBatch:
        now, taken, after = rows[0]["_start"], [], []
        for row in rows:
            taken.append(row["generation"] == now)
            now += taken[-1]
            after.append(now)
        return pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows], key_type), pa.array([r["tie"] for r in rows], pa.int64()), pa.array(taken), pa.array(after, pa.int64())], names=["key", "tie", "taken", "after"])

    begun = start.select(F.col("key").alias("k"), F.col("node").alias("n"), F.col("start").alias("_start"))
    rows = cut.select("key", "_s", F.col("tie").cast("long").alias("tie"), "generation")
    rows = rows.join(begun, rows["key"].eqNullSafe(begun["k"]) & (rows["_s"] == begun["n"])).select("key", "_s", "tie", "generation", "_start")
    told = staged(rows.repartition("key", "_s").sortWithinPartitions("key", "_s", "tie").mapInArrow(by_stretch(verdicts), f"key {types['key']}, tie long, taken boolean, after long"), "writes-verdicts")
    ends = told.groupBy("key").agg(F.max("after").alias("_end"))
    ends = known.join(ends.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "full").select(F.coalesce("key", "k").alias("key"), F.coalesce("_end", "_g").alias("generation"))
    taken = told.where("taken").select(F.col("key").alias("k"), F.col("tie").alias("t"), "after")
    fields = cut.join(taken, cut["key"].eqNullSafe(taken["k"]) & (cut["tie"] == taken["t"])).groupBy("key", "task", "field").agg(F.max_by("value", "after").alias("value")).where("value IS NOT NULL")
    ended = ends.withColumnRenamed("key", "k")
    return told, fields.join(ended, fields["key"].eqNullSafe(ended["k"])).select("key", "generation", "task", "field", "value")


def missing_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target isn't a node."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
