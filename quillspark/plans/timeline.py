"""Queries over plans: customers are people, their last order's day is the anchor, their market segment the path."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline as T
from ..operators.common import staged, table

TODAY = "2000-06-01"
#: Made-up tasks, in the order of operators.timeline.DEFINITION.
TASKS = [
    (0, "collect papers", "soft", False, "separation", -700, -400, None, None, None, None, None, None),
    (1, "book a check-up", "required", False, "separation", -365, -180, -300, None, None, None, None, None),
    (2, "file the claim", "firm", False, "separation", -180, -90, -170, 365, None, None, "BUILDING", -60),
    (3, "pack household", "firm", False, "leaving", -120, -20, -60, None, None, None, None, None),
    (4, "hand in badges", "required", True, "terminal", -10, 0, None, None, None, None, None, None),
    (5, "machine licence", "firm", False, "terminal", -240, -30, None, None, ["MACHINERY", "AUTOMOBILE"], None, None, None),
    (6, "choose a course", "soft", False, "leaving", -400, -100, -200, None, None, ["FURNITURE"], None, None),
    (7, "insure the house", "firm", False, "separation", 0, 120, 30, 240, None, None, None, None),
    (8, "send the survey", "soft", False, "separation", 10, 60, None, None, None, ["HOUSEHOLD", "BUILDING"], None, None),
    (9, "renew the card", "required", False, "separation", -30, 90, None, None, None, None, None, None),
    (10, "close the desk", "firm", True, "leaving", -14, -1, -7, None, None, None, "FURNITURE", -3),
    (11, "apply for funds", "firm", False, "leaving", -90, 30, -80, 700, ["BUILDING"], None, None, None),
]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, way, anchor, terminal, placement): every customer with an order."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("anchor"))
    c = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"))
    key = F.col("c_custkey")
    back = lambda n: F.date_sub("anchor", (key % n - 5).cast("int"))
    rows = c.select(key.alias("person"), F.when(key % 10 != 0, F.col("c_mktsegment")).alias("way"), "anchor", F.when(key % 3 == 0, back(90)).alias("terminal"), F.when(key % 4 == 0, back(120)).alias("placement"))
    return T.personas(rows, "anchor", ("terminal", "placement"))


def _plans(spark: SparkSession, sf_dir: str, today: str = TODAY) -> DataFrame:
    day = F.lit(today).cast("date")
    rows = T.planned(people(spark, sf_dir), TASKS)
    key = (F.col("person") * 7 + F.col("ord")) % 11
    stored = F.when(key == 0, "done").when(key == 1, "skipped").when(key == 2, "snoozed")
    rows = rows.withColumn("stored", stored).withColumn("until", F.when(key == 2, F.date_add(F.lit(TODAY).cast("date"), (F.col("person") % 40 - 10).cast("int"))))
    # a table: what reads it filters on its columns, which would else be pushed down and spelled out many times over
    return staged(T.with_status(rows, day), "plans")


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select("person", "task", "start", "end", "target", "fitted", "cannot_fit", "by_date", "status", "phase", "offset")


def persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("person", "way", "anchor", "terminal", "placement", F.array_join("unused", ",").alias("unused"))


def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tally(_plans(spark, sf_dir), "person")


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).groupBy("phase", "status").agg(F.count("*").alias("n"))


def needs_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.needs_now(_plans(spark, sf_dir), "person", F.lit(TODAY).cast("date")).select("person", "nth", "group", "task")


def next_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.next_task(_plans(spark, sf_dir), "person")


def _events(spark: SparkSession, sf_dir: str, today: str = TODAY) -> DataFrame:
    excluded = (F.col("task") == "insure the house") & (F.col("person") % 8 == 0)
    return T.desired_events(_plans(spark, sf_dir, today), F.lit(today).cast("date"), excluded).select("person", "task", "moment", "title", "date", "alarms")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("alarms", F.array_join(F.transform("alarms", lambda d: d.cast("string")), ","))


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events handed over a hundred days before, for every fifth person a day late, that today's plan doesn't want."""
    old = _events(spark, sf_dir, "2000-02-22").withColumn("date", F.date_add("date", (F.col("person") % 5 == 0).cast("int")))
    return T.stale_events(old, _events(spark, sf_dir), F.lit(TODAY).cast("date")).select(*T.KEY)


def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a hundred days before, brought up to today."""
    day = F.lit(TODAY).cast("date")
    old = _events(spark, sf_dir, "2000-02-22").drop("alarms", "title").withColumn("added_on", F.lit("2000-02-22").cast("date"))
    return T.merged_record(old, _events(spark, sf_dir).drop("alarms", "title"), day, day)


def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.calendar(_events(spark, sf_dir), "person", dt.datetime(2000, 6, 1, 12)).select("person", F.sha2("text", 256).alias("digest"))


def countdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_countdown(_plans(spark, sf_dir), F.lit(TODAY).cast("date"))
    return rows.select("person", "task", "shown_last", F.col("days_left").cast("long").alias("days_left"), "closed_on", "aim", "left", "left_opened", "aim_lapsed", "until_shown", "snooze_closed")


def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.phase_summary(_plans(spark, sf_dir), "person", F.lit(TODAY).cast("date"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict reading of made-up days, why others aren't any, and how days are shown."""
    text = F.concat_ws("-", (F.col("o_orderkey") % 400 + 1850).cast("string"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.when(F.col("o_orderkey") % 50 == 0, (F.col("o_orderkey") % 33).cast("string")).otherwise(F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return o.select("o_orderkey", T.strict_day(F.col("text")).alias("day"), T.day_fault(F.col("text")).alias("fault"), T.shown_day(T.strict_day(F.col("text"))).alias("shown"))


QUERIES = {f"timeline_{f.__name__}": f for f in (projection, persona, tallies, phases, needs_now, next_task, events, stale, record, calendars, countdown, phase_summary, days)}


def _value(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)


_TASKS = ", ".join("(" + ", ".join(_value(v) for v in t) + ")" for t in TASKS)
_PEOPLE = """r AS (SELECT c_custkey AS person, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS way, anchor, CASE WHEN c_custkey % 3 = 0 THEN anchor - (c_custkey % 90 - 5)::INT END AS t, CASE WHEN c_custkey % 4 = 0 THEN anchor - (c_custkey % 120 - 5)::INT END AS p
  FROM customer JOIN (SELECT o_custkey, max(o_orderdate)::DATE AS anchor FROM orders GROUP BY 1) ON o_custkey = c_custkey),
people AS (SELECT person, way, anchor, CASE WHEN t < anchor THEN t END AS terminal, CASE WHEN p < anchor THEN p END AS placement, concat_ws(',', CASE WHEN t >= anchor THEN 'terminal' END, CASE WHEN p >= anchor THEN 'placement' END) AS unused FROM r)"""


def _plan_sql(today: str, suffix: str = "") -> str:
    day = f"DATE '{today}'"
    return f"""d{suffix}(ord, task, kind, from_leaving, finish_before, first, last, aim, final, only_, never_, path, path_last) AS (VALUES {_TASKS}),
a{suffix} AS (SELECT people.*, d.*, CASE WHEN way = path AND path_last IS NOT NULL THEN path_last ELSE last END AS lst, CASE finish_before WHEN 'terminal' THEN terminal WHEN 'leaving' THEN least(placement, terminal) END AS leave
  FROM people, d{suffix} d WHERE (only_ IS NULL OR (way IS NOT NULL AND list_contains(only_, way))) AND NOT (never_ IS NOT NULL AND way IS NOT NULL AND list_contains(never_, way))),
b{suffix} AS (SELECT *, CASE WHEN from_leaving AND leave IS NOT NULL THEN leave ELSE anchor END AS base FROM a{suffix}),
c{suffix} AS (SELECT *, base + first AS start, base + lst AS official_end, base + coalesce(aim, first) AS aimed, anchor + final AS final_end, leave IS NOT NULL AND leave - 1 < base + lst AS fitted FROM b{suffix}),
e{suffix} AS (SELECT *, CASE WHEN fitted THEN leave - 1 ELSE official_end END AS end_ FROM c{suffix}),
f{suffix} AS (SELECT *, fitted AND start > end_ AS cannot_fit, least(aimed, end_) AS target, (least(aimed, end_) - anchor)::BIGINT AS off, (person * 7 + ord) % 11 AS k FROM e{suffix}),
g{suffix} AS (SELECT *, CASE WHEN cannot_fit THEN official_end ELSE end_ END AS judged, CASE k WHEN 2 THEN DATE '{TODAY}' + (person % 40 - 10)::INT END AS until FROM f{suffix}),
h{suffix} AS (SELECT *, CASE WHEN cannot_fit AND {day} <= anchor THEN 'after-you-leave' WHEN {day} < start THEN 'upcoming' WHEN kind = 'soft' THEN CASE WHEN {day} > judged THEN 'still-to-do' ELSE 'start-now' END
  WHEN {day} <= judged THEN CASE WHEN judged - {day} <= 30 THEN 'closing-soon' ELSE 'start-now' END WHEN kind = 'required' THEN CASE WHEN {day} > anchor AND judged < anchor THEN 'closed' ELSE 'late' END WHEN final_end IS NOT NULL AND {day} <= final_end THEN 'changed' ELSE 'closed' END AS by_date FROM g{suffix}),
plans{suffix} AS (SELECT *, CASE WHEN k = 0 THEN 'done' WHEN k = 1 THEN 'skipped' WHEN k = 2 AND until > {day} AND NOT (fitted AND NOT cannot_fit AND {day} >= end_) AND (by_date IN ('upcoming', 'start-now', 'still-to-do') OR by_date = 'after-you-leave' AND kind = 'soft') THEN 'snoozed' ELSE by_date END AS status,
  len(list_filter([-540, -365, -180, -90, 0], lambda x: x <= off))::BIGINT AS phase FROM h{suffix})"""


def _events_sql(today: str, suffix: str = "") -> str:
    day = f"DATE '{today}'"
    return f"""{_plan_sql(today, suffix)},
pl{suffix} AS (SELECT *, CASE WHEN cannot_fit AND {day} > anchor THEN official_end ELSE end_ END AS shown FROM plans{suffix} WHERE NOT (task = 'insure the house' AND person % 8 = 0)),
ev{suffix} AS (SELECT person, task, 'leave' AS moment, shown AS date, CASE WHEN kind = 'soft' THEN [7] ELSE [30, 7, 1] END AS al FROM pl{suffix} WHERE status = 'after-you-leave'
  UNION ALL SELECT person, task, 'aim', CASE WHEN status = 'snoozed' THEN CASE WHEN fitted AND NOT cannot_fit THEN least(until, end_) ELSE until END WHEN target >= {day} THEN target ELSE shown END, [7] FROM pl{suffix} WHERE kind = 'soft' AND status NOT IN ('done', 'skipped', 'after-you-leave')
  UNION ALL SELECT person, task, 'opens', start, [] FROM pl{suffix} WHERE kind <> 'soft' AND status NOT IN ('done', 'skipped', 'after-you-leave') AND start > {day}
  UNION ALL SELECT person, task, 'changes', shown, [30, 7, 1] FROM pl{suffix} WHERE kind <> 'soft' AND status NOT IN ('done', 'skipped', 'after-you-leave') AND final_end IS NOT NULL
  UNION ALL SELECT person, task, 'last', coalesce(final_end, shown), [30, 7, 1] FROM pl{suffix} WHERE kind <> 'soft' AND status NOT IN ('done', 'skipped', 'after-you-leave')),
events_of{suffix} AS (SELECT person, task, moment, date, list_filter(al, lambda x: date - x > {day}) AS alarms FROM ev{suffix} WHERE date >= {day})"""


_PLANS, _NOW, _OLD = f"WITH {_PEOPLE}, {_plan_sql(TODAY)}", f"WITH {_PEOPLE}, {_events_sql(TODAY)}", _events_sql("2000-02-22", "_old")
_TITLE = "CASE moment " + " ".join(f"WHEN '{m}' THEN '{t}'" for m, t in T.TITLES.items()) + " END || task"
_END = "chr(13), chr(10)"
ORACLES = {
    "timeline_projection": f'{_PLANS} SELECT person, task, start, end_ AS "end", target, fitted, cannot_fit, by_date, status, phase, off AS "offset" FROM plans',
    "timeline_persona": f"WITH {_PEOPLE} SELECT person, way, anchor, terminal, placement, unused FROM people",
    "timeline_tallies": f"{_PLANS} SELECT person, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'snoozed') AS snoozed, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status NOT IN ('done', 'skipped', 'snoozed', 'closed')) AS to_do FROM plans GROUP BY person",
    "timeline_phases": f"{_PLANS} SELECT phase, status, count(*) AS n FROM plans GROUP BY phase, status",
    "timeline_needs_now": f"{_PLANS}, n AS (SELECT *, CASE WHEN status = 'late' THEN 'late' WHEN status = 'closing-soon' OR status = 'changed' AND final_end - DATE '{TODAY}' <= 30 THEN 'closing' WHEN status = 'after-you-leave' AND kind <> 'soft' THEN 'after' WHEN status = 'closed' AND DATE '{TODAY}' - CASE WHEN kind = 'required' THEN anchor ELSE coalesce(final_end, judged) END <= 14 THEN 'closed' WHEN status = 'start-now' AND DATE '{TODAY}' - start < 14 THEN 'opened' END AS g FROM plans) SELECT person, row_number() OVER (PARTITION BY person ORDER BY list_position(['late', 'closing', 'after', 'closed', 'opened'], g), status = 'after-you-leave' AND DATE '{TODAY}' > end_, target, ord) AS nth, g AS \"group\", task FROM n WHERE g IS NOT NULL",
    "timeline_next_task": f"{_PLANS}, n AS (SELECT *, CASE WHEN status IN ('late', 'closing-soon', 'changed', 'start-now') THEN 0 WHEN status = 'still-to-do' THEN 1 WHEN status = 'upcoming' THEN 2 WHEN status = 'snoozed' THEN 3 END AS x FROM plans), m AS (SELECT *, CASE WHEN x = 2 THEN start ELSE target END AS w FROM n WHERE x IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY x, w, ord) AS i FROM m) SELECT person, task, status, w AS \"when\" FROM o WHERE i = 1",
    "timeline_events": f"{_NOW} SELECT person, task, moment, {_TITLE} AS title, date, array_to_string(alarms, ',') AS alarms FROM events_of",
    "timeline_stale": f"{_NOW}, {_OLD}, o AS (SELECT person, task, moment, date + (person % 5 = 0)::INT AS date FROM events_of_old) SELECT person, task, moment, date FROM o WHERE date > DATE '{TODAY}' AND NOT EXISTS (SELECT 1 FROM events_of e WHERE (e.person, e.task, e.moment, e.date) = (o.person, o.task, o.moment, o.date))",
    "timeline_record": f"{_NOW}, {_OLD} SELECT person, task, moment, date, DATE '2000-02-22' AS added_on FROM events_of_old WHERE date >= DATE '{TODAY}' UNION ALL SELECT person, task, moment, date, DATE '{TODAY}' FROM events_of e WHERE NOT EXISTS (SELECT 1 FROM events_of_old o WHERE (e.person, e.task, e.moment, e.date) = (o.person, o.task, o.moment, o.date))",
    "timeline_calendars": f"{_NOW}, k AS (SELECT *, {_TITLE} AS title, 'UID:' || sha256(CASE WHEN moment IN ('last', 'aim', 'leave') THEN task ELSE task || ':' || moment END) || '@plan.example' AS u FROM events_of), t AS (SELECT person, date, task, moment, concat('BEGIN:VEVENT', {_END}, left(u, 75), {_END}, ' ', substr(u, 76), {_END}, 'DTSTAMP:20000601T120000Z', {_END}, 'SEQUENCE:13176000', {_END}, 'DTSTART;VALUE=DATE:', strftime(date, '%Y%m%d'), {_END}, 'DTEND;VALUE=DATE:', strftime(date + 1, '%Y%m%d'), {_END}, 'SUMMARY:', title, {_END}, array_to_string(list_transform(alarms, lambda d: concat('BEGIN:VALARM', {_END}, 'ACTION:DISPLAY', {_END}, 'DESCRIPTION:', title, {_END}, 'TRIGGER:', CASE WHEN d = 1 THEN '-PT15H' ELSE '-P' || (d - 1) || 'DT15H' END, {_END}, 'END:VALARM', {_END})), ''), 'END:VEVENT', {_END}) AS body FROM k) SELECT person, sha256(concat('BEGIN:VCALENDAR', {_END}, 'VERSION:2.0', {_END}, 'PRODID:-//Quillspark//Plans//EN', {_END}, 'CALSCALE:GREGORIAN', {_END}, string_agg(body, '' ORDER BY date, task, moment), 'END:VCALENDAR', {_END})) AS digest FROM t GROUP BY person",
    "timeline_countdown": f"{_PLANS}, cd AS (SELECT *, CASE WHEN cannot_fit AND DATE '{TODAY}' > anchor THEN official_end ELSE end_ END AS shown, status = 'after-you-leave' AND DATE '{TODAY}' > end_ AS gone FROM plans) SELECT person, task, shown AS shown_last, CASE status WHEN 'closing-soon' THEN shown - DATE '{TODAY}' WHEN 'changed' THEN final_end - DATE '{TODAY}' END AS days_left, CASE WHEN status = 'closed' AND kind = 'required' THEN anchor END AS closed_on, CASE WHEN kind = 'soft' THEN CASE WHEN target >= DATE '{TODAY}' THEN target ELSE shown END END AS aim, gone AS \"left\", gone AND DATE '{TODAY}' >= start AS left_opened, status = 'still-to-do' AND DATE '{TODAY}' > anchor AND shown <= anchor AS aim_lapsed, CASE WHEN status = 'snoozed' THEN CASE WHEN fitted AND NOT cannot_fit THEN least(until, end_) ELSE until END END AS until_shown, k = 2 AND until > DATE '{TODAY}' AND fitted AND NOT cannot_fit AND DATE '{TODAY}' >= end_ AS snooze_closed FROM cd",
    "timeline_phase_summary": f"{_PLANS}, p AS (SELECT person, phase, min(anchor) AS anchor, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'snoozed') AS snoozed, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status NOT IN ('done', 'skipped', 'snoozed', 'closed')) AS to_do, count(*) FILTER (status = 'closed' AND DATE '{TODAY}' - CASE WHEN kind = 'required' THEN anchor ELSE coalesce(final_end, judged) END <= 14) AS news FROM plans GROUP BY person, phase) SELECT person, phase, done, skipped, snoozed, closed, to_do, to_do = 0 AND snoozed = 0 AND news = 0 AS collapsible, (sum(([-540, -365, -180, -90, 0, 730][phase + 1] <= DATE '{TODAY}' - anchor)::INT) OVER (PARTITION BY person))::BIGINT AS marker FROM p",
    "timeline_days": "WITH t AS (SELECT o_orderkey, concat_ws('-', (o_orderkey % 400 + 1850)::VARCHAR, lpad((o_orderkey % 14)::VARCHAR, 2, '0'), CASE WHEN o_orderkey % 50 = 0 THEN (o_orderkey % 33)::VARCHAR ELSE lpad((o_orderkey % 33)::VARCHAR, 2, '0') END) AS text FROM orders), f AS (SELECT *, CASE WHEN NOT regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'format' WHEN left(text, 4)::INT NOT BETWEEN 1900 AND 2200 THEN 'year' WHEN text[6:7]::INT NOT BETWEEN 1 AND 12 THEN 'month' WHEN try_cast(text AS DATE) IS NULL THEN 'day' END AS fault FROM t) SELECT o_orderkey, CASE WHEN fault IS NULL THEN text::DATE END AS day, fault, CASE WHEN fault IS NULL THEN strftime(text::DATE, '%b %-d, %Y') END AS shown FROM f",
}
