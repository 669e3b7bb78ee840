"""Streams with timers against their batch forms: any order within the delay, any cut into micro-batches, restarts, state that goes."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import stateful as S
from quillspark.streaming import timers

DAY = 86_400


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    """Events of one user in four, shuffled within an hour, as a stream of files; the last file has one row far ahead, so that all
    others are passed."""
    timers.with_rocksdb(spark)
    table = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.ceil("value").cast("long").alias("units")).where("user_id % 4 = 1")
    folder = str(tmp_path_factory.mktemp("stream"))
    rows = table.toPandas()
    rows["at"] = rows["ts"].astype("int64") // 10**9 + rows["event_id"] * 7919 % 3600
    rows = rows.sort_values("at").drop(columns="at")
    for k in range(3):
        spark.createDataFrame(rows.iloc[k * len(rows) // 3 : (k + 1) * len(rows) // 3], table.schema).coalesce(1).write.mode("append").parquet(folder)
    ahead = table.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("event_id", F.lit(-1).cast("long")).withColumn("user_id", F.lit(-1).cast("long"))
    ahead.coalesce(1).write.mode("append").parquet(folder)
    return table, lambda most=1: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", most).option("latestFirst", False).parquet(folder)


def finished(spark, df, folder):
    out, at = f"{folder}/out", f"{folder}/checkpoint"
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(600)
    return [tuple(r) for r in spark.read.schema(df.schema).parquet(out).collect()]


def test_idle_spells(spark, events, tmp_path):
    table, stream = events
    got = finished(spark, timers.idle_spells(stream(), "user_id", "ts", "event_id", 600, "2 hours"), tmp_path)
    want = S.idle_spells(table, "user_id", "ts", 600).collect()
    assert len(want) > 50 and sorted(x for x in got if x[0] >= 0) == sorted((r["user_id"], r["since"], r["fired"]) for r in want)


def test_daily_budget_and_restart(spark, events, tmp_path):
    """The second run goes on from the first one's checkpoint."""
    table, stream = events
    plan = lambda s: timers.daily_budget(s, "ts", "event_id", "units", 300, "2 hours")
    query = plan(stream()).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").start()
    while not query.recentProgress or len([p for p in query.recentProgress if p["numInputRows"] > 0]) < 1:
        assert query.isActive, query.exception()
    query.stop()
    got = finished(spark, plan(stream()), tmp_path)
    want = S.within_daily_budget(table, "ts", "event_id", "units", 300).select("event_id", F.unix_date("day").cast("long"), "before", "allowed").collect()
    seen = {x[0]: x for x in got if x[0] >= 0}
    assert len(seen) == len([x for x in got if x[0] >= 0])
    for r in want:
        assert seen[r[0]][3] == r[3] and (not r[3] or seen[r[0]] == tuple(r))
    assert len(seen) == len(want)


def test_merged_writes(spark, tmp_path):
    timers.with_rocksdb(spark)
    rows = [(1, 10, 0, 0, "a", "status", "done"), (1, 11, 1, 1, "a", "note", "n"), (1, 12, 2, 1, "a", "note", "late"), (1, 13, 3, 2, "b", "status", "x"), (1, 14, 4, 3, "a", "status", None), (2, 10, 5, 1, "a", "status", "lost"), (1, 9, 6, 5, "a", "status", "ahead")]
    df = spark.createDataFrame(rows, "key long, at long, tie long, generation long, task string, field string, value string").select("*", F.timestamp_seconds("at").alias("ts"))
    folder = f"{tmp_path}/in"
    for part in (df.where("tie in (4, 2, 5)"), df.where("tie not in (4, 2, 5)"), df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(10**6))).withColumn("key", F.lit(-1).cast("long"))):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = finished(spark, timers.merged_writes(stream, "key", "ts", "tie", "1 hour"), tmp_path)
    want = {r["tie"]: r["taken"] for r in S.merged_writes(df.select("key", "tie", "generation", "task", "field", "value").limit(0).unionByName(df.select("key", F.col("at").alias("tie"), "generation", "task", "field", "value")), spark.createDataFrame([], "key long, generation long"), 2)[0].collect() if r["key"] == 1}
    assert {x[1]: x[2] for x in got if x[0] >= 0} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: False}
    assert want == {9: False, 10: True, 11: True, 12: False, 13: True, 14: True}
    assert [x[3:] for x in sorted(got) if x[1] == 4] == [(4, "a", "status", None)] and [x[6] for x in got if x[1] == 2] == ["n"]
