"""Hash trees over tables, and what a build knows of its sources."""

import hashlib
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from quillspark.operators import fingerprints as P
from quillspark.operators import registry as G


def plain_root(rows, depth):
    """The tree by lists and sorting."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    times = Counter(sha(json.dumps([None if v is None else str(v) for v in r], separators=(",", ":"), ensure_ascii=False)) for r in rows)
    nodes = {}
    for row, n in sorted(times.items()):
        nodes.setdefault(row[:depth], []).append(f"{row}:{n}")
    nodes = {p: sha(",".join(x)) for p, x in nodes.items()}
    for d in range(depth - 1, -1, -1):
        up = {}
        for p, digest in sorted(nodes.items()):
            up.setdefault(p[:d], []).append(f"{p}:{digest}")
        nodes = {p: sha(",".join(x)) for p, x in up.items()}
    return nodes.get("", sha(""))


def test_against_a_plain_tree(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.choice([None, "", "x", "é\"\\"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b string")
    for leaf in (1000, 30, 2):
        got = P.revision(df, leaf=leaf).first()
        assert got["depth"] == P.depth_for(len(set(rows)), leaf) and got["n"] == 300
        assert got["revision"] == plain_root(rows, got["depth"])
    assert P.depth_for(0) == P.depth_for(256) == 0 and P.depth_for(257) == 1 and P.depth_for(256 * 16 + 1) == 2


def test_order_and_dealing_make_no_difference_but_any_edit_does(spark):
    df = spark.range(2000).select("id", (F.col("id") % 5).alias("tag"), F.lit(None).cast("string").alias("note"))
    one = lambda d, *a: P.revision(d, *a).first()["revision"]
    base = one(df)
    assert one(df.repartition(9).sort(F.desc("tag"))) == base and one(df.select("tag", "note", "id")) == base
    assert len({base, one(df.where("id > 0")), one(df.unionByName(df.where("id = 7"))), one(df.withColumn("note", F.lit(""))), one(df.withColumn("tag", F.when(F.col("id") == 9, 8).otherwise(F.col("tag"))))}) == 5
    assert one(df.withColumn("tag", F.lit(0)), ["id"]) == one(df, ["id"])
    assert P.revision(df.where("false")).first()["n"] == 0


def test_only_differing_leaves_are_compared(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("v"))
    new = df.where("id <> 11").withColumn("v", F.when(F.col("id") == 70, 9).otherwise(F.col("v"))).unionByName(df.where("id = 4"))
    a, b = P.row_digests(df), P.row_digests(new)
    depth = P.depth_for(5000, 16)
    paths = {r["path"] for r in P.differing_leaves(a, b, depth).collect()}
    assert depth == 3 and 1 <= len(paths) <= 4
    got = sorted(tuple(r) for r in P.differing_rows(df, new, "id", leaf=16).collect())
    assert got == [(4, "added", 1), (11, "removed", 1), (70, "added", 1), (70, "removed", 1)]
    assert P.differing_rows(df, df.repartition(3), "id").count() == 0


def test_build_state(spark):
    src = lambda *x: spark.createDataFrame([(s,) for s in x], "source string")
    hashed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "3"), (None, "9")], "source string, hash string")
    approvals = spark.createDataFrame([("a", "1", "approved"), ("b", "2", "pending"), ("c", "old", "approved"), ("d", None, "odd")], "source string, hash string, decision string")
    f = G.source_fingerprints(src("a", "b", "c", "d", "d"), hashed, approvals, src("a", "b"))
    each, whole = G.chain_state(f, "h", "h")
    assert {r["source"]: (r["ingest"], r["clean"], r["chunk"]) for r in each.collect()} == {"a": ("skip", "skip", "skip"), "b": ("skip", "gate-pending", "run"), "c": ("skip", "run", "run"), "d": ("run", "run", "run")}
    assert tuple(whole.first()) == ("skip", 4, 1, ["b"])
    assert tuple(G.chain_state(f.where("false"), None, "h")[1].first()) == ("run", 0, 0, [])


def test_reason_of_a_change(spark):
    lit = lambda x: F.lit(x)
    got = lambda *a: tuple(spark.range(1).select(G.change(*map(lit, a)).alias("x")).first()["x"])
    assert got("a", "2024-01-01", "b", "2024-02-01", False) == ("changed", "hash")
    assert got("a", "2024-01-01", "a", "2024-02-01", False) == ("changed", "date")
    assert got("a", None, None, "2024-02-01", None) == ("unchanged", None) and got("a", "1", "b", "2", True) == ("manual", "unfetchable")


def test_the_table_dealt_anew_has_no_large_part(spark, sf):
    """Whole rows are dealt by a key of which no value has many, whatever the number of partitions."""
    from unittest import mock

    from quillspark.plans import registry

    dealt = []
    with mock.patch.object(registry.P, "revision", lambda df: dealt.append(df) or df.selectExpr("'' AS revision", "0L AS n").limit(0)):
        registry.fingerprints(spark, sf)
    most = dealt[0].groupBy("lang").count().agg(F.max("count")).first()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in dealt[1].groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < most and max(sizes) < 2 * sum(sizes) / len(sizes)
