"""Continuous operators over a stream of files against their batch forms over the table."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import stateful as S
from quillspark.streaming import twins


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    """The events as a stream of three files in the order of time, and as a table."""
    table = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.ceil("value").cast("long").alias("units"))
    folder = str(tmp_path_factory.mktemp("stream"))
    rows = table.toPandas().sort_values(["ts", "event_id"])
    for k in range(3):
        part = spark.createDataFrame(rows.iloc[k * len(rows) // 3 : (k + 1) * len(rows) // 3], table.schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return table, lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finished(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_daily_budget(spark, events):
    table, stream = events
    got = finished(spark, twins.daily_budget(stream().select(F.col("event_id").alias("id"), "ts", "units")).select("id", "allowed"), "budget")
    want = S.within_daily_budget(table, "ts", "event_id", "units").select("event_id", "allowed")
    assert got == sorted(tuple(r) for r in want.collect())


def test_marks_and_back_off(spark, events):
    table, stream = events
    steps = lambda df: df.withColumn("micros", F.unix_micros("ts"))
    got = finished(spark, twins.marks(steps(stream()).select(F.col("user_id").alias("who"), F.col("micros").alias("step"), "micros"), cap_days=2).select("who", "step", "mark"), "marks")
    rows = steps(table)
    want = S.marks(rows.select("user_id", F.col("micros").alias("step"), "ts"), "user_id", "step", "ts", cap_days=2).select("user_id", "step", "mark")
    assert got == sorted(tuple(r) for r in want.collect())
    failed = F.col("event_type").isin("error", "view")
    got = finished(spark, twins.back_off(steps(stream()).select(F.col("user_id").alias("who"), F.col("micros").alias("step"), failed.alias("failed"))), "tries")
    want = S.failures_in_a_row(rows, "user_id", "micros", failed).select("user_id", "micros", "failures", "wait")
    assert got == sorted(tuple(r) for r in want.collect())


def test_slices_and_sessions(spark, events):
    table, stream = events
    slices = finished(spark, twins.rate_counts(stream(), "user_id", "ts", 3600, 1, "0 seconds").select("user_id", F.unix_timestamp("start").alias("s"), "n", "refused"), "slices")
    counts = table.groupBy("user_id", (F.floor(F.unix_timestamp("ts") / 3600) * 3600).alias("s")).agg(F.count("*").alias("n"))
    all_ = {(r[0], r[1]): r[2] for r in counts.collect()}
    assert slices and all(all_[u, s] == n and refused == n - 1 for u, s, n, refused in slices) and len(slices) >= 0.9 * len(all_)
    sessions = finished(spark, twins.session_counts(stream(), "user_id", "ts", 240, "0 seconds").select("user_id", F.unix_micros("started").alias("s"), "n"), "sessions")
    want = {(r["user_id"], r["started"], r["n"]) for r in S.sessions(table, "user_id", "ts", "event_id", 240).collect()}
    assert sessions and set(sessions) <= want and len(sessions) >= 0.8 * len(want)


def test_files_by_reach_and_writes(spark):
    nodes = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (3, False, "c"), (4, False, "b")], "node long, entry boolean, file string")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert {tuple(r) for r in S.split_by_reach(nodes, edges).collect()} == {("a", True), ("b", True), ("c", False)}
    with pytest.raises(ValueError, match="no node"):
        S.split_by_reach(nodes, edges.unionByName(spark.createDataFrame([(1, 9)], "src long, dst long")))
    state = spark.createDataFrame([("k", 3, "old"), ("q", 1, "same")], "key string, generation long, value string")
    writes = spark.createDataFrame([("k", 3, "b"), ("k", 3, "a"), ("k", 2, "late"), ("n", 0, "new"), ("q", 0, "late")], "key string, generation long, value string")
    got = {r["key"]: (r["generation"], r["value"], r["conflict"]) for r in S.written(state, writes).collect()}
    assert got == {"k": (4, "a", True), "n": (1, "new", False), "q": (1, "same", True)}
