"""Queries over events: budgets, limits, sessions, marks, back-off, latest state, and reachability over made-up edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stateful as S
from ..operators.common import table


def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.ceil("value").cast("long").alias("units"))
    return S.within_daily_budget(e, "ts", "event_id", "units").select("event_id", "units", "before", "allowed")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve hours and two requests stand for the short slices of a busy service."""
    return S.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 43_200, 2).select("event_id", "user_id", "allowed")


def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 240)


def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks over readings in the order of their ids, with steps of two days at most."""
    return S.marks(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", cap_days=2)


def back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return S.failures_in_a_row(e, "user_id", "event_id", F.col("event_type").isin("error", "view", "click")).select("event_id", "failures", "wait")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers reached from every hundredth over edges to a third of their number and, from the first, back to the seventh."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"))
    edges = c.select("src", F.when(F.col("src") == 1, 7).otherwise(F.floor(F.col("src") / 3)).cast("long").alias("dst"))
    return S.reachable(c.where("src % 100 = 0").select(F.col("src").alias("node")), edges)


def lost_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, as edges to customers, of whose customer number plus a hundred there is none."""
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return S.missing_targets(nodes, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 100).alias("dst")))


def idle_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pause of ten hours or longer after an event of a user, once."""
    return S.idle_spells(table(spark, sf_dir, "events"), "user_id", "ts", 600, 1_706_745_600_000_000)


def _writes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as writes to records of fifty groups of customers, one of which has a third of them; every second record is there already."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        F.when(k % 3 == 0, 0).otherwise(F.col("o_custkey") % 50).cast("long").alias("key"), k.alias("tie"), (k % 37 % 11).alias("generation"),
        F.concat(F.lit("t"), (k % 4).cast("string")).alias("task"), F.when(k % 2 == 0, "status").otherwise("note").alias("field"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("value"),
    )
    state = spark.range(0, 50, 2).select(F.col("id").alias("key"), (F.col("id") % 3).alias("generation"))
    return o, state


def merged_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which optimistic writes count, and the generation after each."""
    return S.merged_writes(*_writes(spark, sf_dir), width=1000)[0]


def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What those writes leave of each record's tasks."""
    return S.merged_writes(*_writes(spark, sf_dir), width=1000)[1]


QUERIES = {f"state_{f.__name__}": f for f in (daily_budget, rate_limit, activity_sessions, last_seen, back_off, latest_state, reached, lost_targets, idle_spells, merged_writes, merged_fields)}

_WRITES = """o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 50 END AS key, o_orderkey AS tie, o_orderkey % 37 % 11 AS g, 't' || (o_orderkey % 4) AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'status' ELSE 'note' END AS field, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS value FROM orders),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tie) AS i FROM o), s AS (SELECT range AS key, range % 3 AS g FROM range(0, 50, 2)),
r AS (SELECT n.key, i, tie, n.g = coalesce(s.g, 0) AS taken, coalesce(s.g, 0) + (n.g = coalesce(s.g, 0))::INT AS after FROM n LEFT JOIN s USING (key) WHERE i = 1
  UNION ALL SELECT n.key, n.i, n.tie, n.g = r.after, r.after + (n.g = r.after)::INT FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)"""
ORACLES = {
    "state_daily_budget": "SELECT event_id, units, coalesce(b, 0)::BIGINT AS before, coalesce(b, 0) < 6500 AS allowed FROM (SELECT event_id, ceil(value)::BIGINT AS units, sum(ceil(value)::BIGINT) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)",
    "state_rate_limit": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 43200000000 ORDER BY ts, event_id) <= 2 AS allowed FROM events",
    "state_activity_sessions": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 14400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, session::BIGINT AS session, min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS ended, count(*) AS n FROM s GROUP BY user_id, session",
    "state_last_seen": "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), r AS (SELECT user_id, event_id, now, n, now AS mark FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.now, o.n, greatest(r.mark, least(o.now, r.mark + 172800000000)) FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) SELECT user_id, event_id, mark, mark - now > 86400000000 AS late FROM r",
    "state_back_off": "WITH f AS (SELECT *, event_type IN ('error', 'view', 'click') AS failed FROM events), r AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f), c AS (SELECT event_id, sum(failed::INT) OVER (PARTITION BY user_id, run ORDER BY event_id)::BIGINT AS failures FROM r) SELECT event_id, failures, CASE WHEN failures <= 3 THEN 0 WHEN failures = 4 THEN 30 WHEN failures = 5 THEN 60 WHEN failures = 6 THEN 300 ELSE 900 END::BIGINT AS wait FROM c",
    "state_latest_state": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "state_reached": "WITH RECURSIVE e AS (SELECT c_custkey AS src, CASE WHEN c_custkey = 1 THEN 7 ELSE c_custkey // 3 END AS dst FROM customer), r AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 100 = 0 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node::BIGINT AS node FROM r",
    "state_lost_targets": "SELECT o_orderkey AS src, o_custkey + 100 AS dst FROM orders WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)",
    "state_idle_spells": "WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) AS since FROM events), n AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY user_id ORDER BY since), 1706745600000000) AS nxt FROM t) SELECT user_id, since, since + 36000000000 AS fired FROM n WHERE nxt - since >= 36000000000",
    "state_merged_writes": f"WITH RECURSIVE {_WRITES} SELECT key, tie, taken, after::BIGINT AS after FROM r",
    "state_merged_fields": f"WITH RECURSIVE {_WRITES}, e AS (SELECT key, max(after) AS generation FROM r GROUP BY key) SELECT key, generation::BIGINT AS generation, task, field, value FROM (SELECT key, task, field, value, row_number() OVER (PARTITION BY key, task, field ORDER BY after DESC) AS k FROM r JOIN n USING (key, i) WHERE taken) JOIN e USING (key) WHERE k = 1 AND value IS NOT NULL",
}
