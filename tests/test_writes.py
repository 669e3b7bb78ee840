"""Optimistic writes replayed by stretches, quiet spells, and short rules over replies, reports and pictures."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.functions import decisions as D
from quillspark.functions import text as T
from quillspark.operators import rules as R
from quillspark.operators import sources as S
from quillspark.operators import stateful as W


def plain(writes, state):
    now, told, fields = dict(state), {}, {}
    for key, tie, generation, task, field, value in sorted(writes, key=lambda w: w[1]):
        taken = generation == now.get(key, 0)
        now[key] = now.get(key, 0) + taken
        told[key, tie] = (taken, now[key])
        if taken:
            fields[key, task, field] = value
    return told, {(k, now[k], t, f, v) for (k, t, f), v in fields.items() if v is not None}


def test_writes_against_a_replay(spark):
    rng = random.Random(1)
    ties = rng.sample(range(-200, 3000), 900)
    writes = [(rng.choice([1, 1, 1, 2, 3, None]), t, rng.choice([None, 0, 1, 2, 3, 4, 5, 6, 7]), rng.choice("ab"), rng.choice("xy"), rng.choice([None, "p", "q"])) for t in ties]
    # one record whose writes always fit
    writes += [(9, 4000 + i, i, "a", "x", str(i)) for i in range(300)]
    state = [(2, 3), (7, 1)]
    df = spark.createDataFrame(writes, "key int, tie long, generation long, task string, field string, value string").repartition(5)
    st = spark.createDataFrame(state, "key int, generation long")
    want = plain(writes, state)
    for width in (1 << 20, 400):
        told, fields = W.merged_writes(df, st, width)
        assert {(r["key"], r["tie"]): (r["taken"], r["after"]) for r in told.collect()} == want[0]
        assert {tuple(r) for r in fields.collect()} == want[1]
    told, fields = W.merged_writes(df.where("false"), st)
    assert told.count() == 0 and fields.count() == 0


def test_idle_spells(spark):
    minute = 60_000_000
    rows = [(1, 0), (1, 15 * minute), (1, 29 * minute), (1, 29 * minute), (2, 5 * minute), (None, 0), (3, None)]
    df = spark.createDataFrame(rows, "who int, us long").select("who", F.timestamp_micros("us").alias("ts"))
    got = {tuple(r) for r in W.idle_spells(df, "who", "ts", 15, 43 * minute).collect()}
    assert got == {(1, 0, 15 * minute), (2, 5 * minute, 20 * minute), (None, 0, 15 * minute)}
    assert (1, 29 * minute, 44 * minute) in {tuple(r) for r in W.idle_spells(df, "who", "ts", 15).collect()}


def test_occurrences(spark):
    rows = [("aaaa", "aa"), ("a.b.a", "."), ("x", ""), ("\\E\\E", "\\E"), (None, "a"), ("abc", "z"), ("é é", "é")]
    got = [r["n"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string").orderBy("i").select(T.occurrences(F.col("t"), F.col("p")).alias("n")).collect()]
    assert got == [3, 2, 0, 2, None, 0, 2]


def test_replies_and_days(spark):
    rows = [("results", "1", True), ("results", "2", True), ("results", "1", None), ("empty", "1", None), ("empty", None, None), ("high_demand", None, None), (None, "1", True), ("odd", "1", True)]
    got = [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, v string, h boolean").orderBy("i").select(D.handshake(F.col("s"), F.col("v"), "1", F.col("h")).alias("x")).collect()]
    assert got == ["results", "error", "error", "empty", "error", "high_demand", "error", "error"]
    day = spark.range(1).select(D.local_day(F.lit("2024-03-10 04:30:00").cast("timestamp"), "America/New_York").alias("d"), D.snoozed_until(F.lit("2024-01-31").cast("date"), 30).alias("u")).first()
    assert str(day["d"]) == "2024-03-09" and str(day["u"]) == "2024-03-01"


def test_paints_and_placement(spark):
    paints = lambda *ops: spark.createDataFrame([([o for o, _, _ in ops], [w for _, w, _ in ops], [h for _, _, h in ops])], "o array<string>, w array<int>, h array<int>").select(S.image_paints(F.col("o"), F.col("w"), F.col("h")).alias("n")).first()["n"]
    assert paints(("paintImageXObject", 2, 1), ("paintImageXObject", 1, 1), ("fill", 9, 9), ("paintImageMaskXObject", 3, 3)) == 2
    with pytest.raises(PySparkException, match="merged"):
        paints(("paintImageXObjectRepeat", 1, 1))
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert tuple(R.placement(a, b, "k").first()) == (False, 2, 2) and tuple(R.placement(b, a, "k").first()) == (True, 0, None)
    assert [r["source"] for r in S.with_pictures(spark.createDataFrame([("b", 1), ("a", 0), ("b", 2), ("c", None)], "source string, kept int")).collect()] == ["b"]


def test_reports(spark):
    df = spark.createDataFrame([("a", "changed", "r", "o", "n"), ("b", "unchanged", "r", "o", "n"), ("c", "manual-check-required", "r", "o", None)], "source string, status string, reason string, old_hash string, new_hash string")
    got = [(r["ord"], r["source"], r["line"]) for r in S.review_report(df, "T").orderBy("ord", "source").collect()]
    assert got[0] == (0, None, "# T") and got[1] == (1, None, "changed: 1, manual-check-required: 1, unchanged: 1") and [x[1] for x in got[2:]] == ["a", "c"] and got[3][2].endswith("(unfetched)")
    assert [r["line"] for r in S.review_report(df.where("false"), "T").orderBy("ord").collect()][-1] == "nothing to review"
