"""Task definitions projected onto dates, judged against a day, and turned into calendar events.

Definitions are a short literal list; they are exploded beside each person's row, so no join is needed. Null dates are dates
that a person hasn't given; a null path hides what is for listed paths alone and shows what is for all but listed ones.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import alarm_trigger
from ..functions.text import calendar_escaped

#: Days left at which a firm task counts as closing. Fixed values, like those below.
CLOSING = 30
#: Days for which a task that closed, or that opened, is news.
NEWS = 14
#: Starts of all phases but the first, in days from the anchor.
PHASES = (-540, -365, -180, -90, 0)
LAST_PHASE_END = 730
#: Seconds of 2000-01-01, from which versions of calendars count.
VERSION_EPOCH = 946_684_800
FIRM_ALARMS, SOFT_ALARMS = (30, 7, 1), (7,)
GROUPS = ("late", "closing", "after", "closed", "opened")
DEFINITION = ("ord long", "task string", "kind string", "from_leaving boolean", "finish_before string", "first int", "last int", "aim int", "final int", "only array<string>", "never array<string>", "path string", "path_last int")


def _literal(value, kind: str) -> Column:
    if isinstance(value, list):
        return F.array(*[F.lit(x) for x in value]).cast(kind)
    return F.lit(value).cast(kind)


def personas(df: DataFrame, anchor: str, leaves: Sequence[str]) -> DataFrame:
    """Leave dates that aren't before the anchor become null; ``unused`` lists their columns."""
    late = [F.when(F.col(c) >= F.col(anchor), c) for c in leaves]
    out = df.withColumn("unused", F.array_compact(F.array(*late)))
    return out.withColumns({c: F.when(F.col(c) < F.col(anchor), F.col(c)) for c in leaves})


def planned(people: DataFrame, definitions: Sequence[tuple]) -> DataFrame:
    """Rows of ``people`` (anchor, terminal, placement dates, persona path in ``way``) beside the tasks that are theirs, with
    leave, start, official_end, end, fitted, cannot_fit, target, offset and final_end."""
    names = [c.split(" ", 1) for c in DEFINITION]
    structs = [F.struct(*[_literal(v, kind).alias(n) for v, (n, kind) in zip(d, names, strict=True)]) for d in definitions]
    rows = people.withColumn("_d", F.explode(F.array(*structs))).select("*", "_d.*").drop("_d")
    theirs = F.coalesce(F.array_contains("only", F.col("way")), F.col("only").isNull()) & ~F.coalesce(F.array_contains("never", F.col("way")), F.lit(False))
    rows = rows.where(theirs).withColumn("last", F.when(F.col("way") == F.col("path"), F.coalesce("path_last", "last")).otherwise(F.col("last")))
    leave = F.when(F.col("finish_before") == "terminal", F.col("terminal")).when(F.col("finish_before") == "leaving", F.least("placement", "terminal"))
    rows = rows.withColumn("leave", leave).withColumn("_base", F.when(F.col("from_leaving"), F.coalesce("leave", "anchor")).otherwise(F.col("anchor")))
    day = lambda base, c: F.date_add(F.col(base), F.col(c))
    rows = rows.withColumns({"start": day("_base", "first"), "official_end": day("_base", "last"), "_aim": F.date_add(F.col("_base"), F.coalesce("aim", "first")), "final_end": day("anchor", "final")})
    rows = rows.withColumn("fitted", F.coalesce(F.date_sub("leave", 1) < F.col("official_end"), F.lit(False)))
    rows = rows.withColumn("end", F.when(F.col("fitted"), F.date_sub("leave", 1)).otherwise(F.col("official_end")))
    rows = rows.withColumn("cannot_fit", F.col("fitted") & (F.col("start") > F.col("end"))).withColumn("target", F.least("_aim", "end"))
    return rows.withColumn("offset", F.date_diff("target", "anchor").cast("long")).drop("_base", "_aim", "first", "last", "aim", "final", "only", "never", "path", "path_last")


def date_status(today: Column) -> Column:
    """What the dates alone say of a planned row."""
    end = F.when(F.col("cannot_fit"), F.col("official_end")).otherwise(F.col("end"))
    return (
        F.when(F.col("cannot_fit") & (today <= F.col("anchor")), "after-you-leave")
        .when(today < F.col("start"), "upcoming")
        .when((F.col("kind") == "soft") & (today > end), "still-to-do")
        .when(F.col("kind") == "soft", "start-now")
        .when((today <= end) & (F.date_diff(end, today) <= CLOSING), "closing-soon")
        .when(today <= end, "start-now")
        .when((F.col("kind") == "required") & (today > F.col("anchor")) & (end < F.col("anchor")), "closed")
        .when(F.col("kind") == "required", "late")
        .when(F.coalesce(today <= F.col("final_end"), F.lit(False)), "changed")
        .otherwise("closed")
    )


def with_status(rows: DataFrame, today: Column) -> DataFrame:
    """Adds by_date, status and phase. ``stored`` (done, skipped, snoozed or null) and ``until`` come with the rows: done and
    skipped win; a snooze ends on its day or the last day that leaving allows, and hides no warning."""
    rows = rows.withColumn("by_date", date_status(today))
    due = F.col("fitted") & ~F.col("cannot_fit") & (today >= F.col("end"))
    quiet = F.col("by_date").isin("upcoming", "start-now", "still-to-do") | ((F.col("by_date") == "after-you-leave") & (F.col("kind") == "soft"))
    asleep = (F.col("stored") == "snoozed") & (F.col("until") > today) & ~due & quiet
    status = F.when(F.col("stored").isin("done", "skipped"), F.col("stored")).when(F.coalesce(asleep, F.lit(False)), "snoozed").otherwise(F.col("by_date"))
    phase = sum((F.col("offset") >= p).cast("long") for p in PHASES)
    return rows.withColumns({"status": status, "phase": phase})


def shown_end(today: Column) -> Column:
    """The last day that is shown: once the anchor is past, the official one of what didn't fit."""
    return F.when(F.col("cannot_fit") & (today > F.col("anchor")), F.col("official_end")).otherwise(F.col("end"))


def with_countdown(rows: DataFrame, today: Column) -> DataFrame:
    """Adds what goes with a status: shown_last, days_left to the next firm edge, closed_on, aim (soft tasks), left and left_opened
    (what had to wait and is past), aim_lapsed, until_shown (a snooze ends with a pulled-in window) and snooze_closed."""
    s, soft, last = F.col("status"), F.col("kind") == "soft", shown_end(today)
    fits = F.col("fitted") & ~F.col("cannot_fit")
    left = (s == "after-you-leave") & (today > F.col("end"))
    return rows.withColumns(
        {
            "shown_last": last,
            "days_left": F.when(s == "closing-soon", F.date_diff(last, today)).when(s == "changed", F.date_diff("final_end", today)),
            "closed_on": F.when((s == "closed") & (F.col("kind") == "required"), F.col("anchor")),
            "aim": F.when(soft, F.when(F.col("target") >= today, F.col("target")).otherwise(last)),
            "left": left,
            "left_opened": left & (today >= F.col("start")),
            "aim_lapsed": (s == "still-to-do") & (today > F.col("anchor")) & (last <= F.col("anchor")),
            "until_shown": F.when(s == "snoozed", F.when(fits, F.least("until", "end")).otherwise(F.col("until"))),
            "snooze_closed": F.coalesce((F.col("stored") == "snoozed") & (F.col("until") > today) & fits & (today >= F.col("end")) & ~s.isin("done", "skipped"), F.lit(False)),
        }
    )


def phase_summary(rows: DataFrame, person: str, today: Column) -> DataFrame:
    """(person, phase, done, skipped, snoozed, closed, to_do, collapsible, marker) for each phase that has tasks: collapsible if nothing
    in it is left to act on or just closed; marker is where today stands among the person's phases, counted from 0."""
    s = F.col("status")
    over = F.when(F.col("kind") == "required", F.col("anchor")).otherwise(F.coalesce("final_end", shown_end(today)))
    news = (s == "closed") & (F.date_diff(today, over) <= NEWS)
    kinds = ("done", "skipped", "snoozed", "closed")
    counts = [F.count_if(s == k).alias(k) for k in kinds]
    out = rows.groupBy(person, "phase").agg(*counts, F.count_if(~s.isin(*kinds)).alias("to_do"), F.count_if(news).alias("_news"), F.min("anchor").alias("_anchor"))
    ends = F.element_at(F.array(*[F.lit(x) for x in (*PHASES, LAST_PHASE_END)]), (F.col("phase") + 1).cast("int"))
    past = (ends <= F.date_diff(today, "_anchor")).cast("long")
    out = out.withColumn("collapsible", (F.col("to_do") == 0) & (F.col("snoozed") == 0) & (F.col("_news") == 0))
    return out.withColumn("marker", F.sum(past).over(Window.partitionBy(person))).drop("_news", "_anchor")


def tally(rows: DataFrame, person: str) -> DataFrame:
    """How many tasks of each person are done, skipped, snoozed, closed and to do."""
    kinds = {"done": "done", "skipped": "skipped", "snoozed": "snoozed", "closed": "closed"}
    counts = [F.count_if(F.col("status") == s).alias(n) for n, s in kinds.items()]
    return rows.groupBy(person).agg(*counts, F.count_if(~F.col("status").isin(*kinds.values())).alias("to_do"))


def needs_now(rows: DataFrame, person: str, today: Column) -> DataFrame:
    """The tasks that want attention, each once: group (see GROUPS) and nth within the person, by group (of what must wait until
    after leaving, first what isn't past), target and order."""
    s, soft = F.col("status"), F.col("kind") == "soft"
    over = F.when(F.col("kind") == "required", F.col("anchor")).otherwise(F.coalesce("final_end", shown_end(today)))
    left = (s == "after-you-leave") & (today > F.col("end"))
    group = (
        F.when(s == "late", 0)
        .when(s == "closing-soon", 1)
        .when((s == "changed") & (F.date_diff("final_end", today) <= CLOSING), 1)
        .when((s == "after-you-leave") & ~soft, 2)
        .when((s == "closed") & (F.date_diff(today, over) <= NEWS), 3)
        .when((s == "start-now") & (F.date_diff(today, "start") < NEWS), 4)
    )
    out = rows.withColumn("_g", group).where("_g IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(person).orderBy("_g", left.cast("int"), "target", "ord")).cast("long")
    return out.withColumn("nth", nth).withColumn("group", F.element_at(F.array(*map(F.lit, GROUPS)), F.col("_g") + 1)).drop("_g")


def next_task(rows: DataFrame, person: str) -> DataFrame:
    """One task for each person: the first open one, else the first still to do, else the one that opens first, else the
    first snoozed one. Combined before the shuffle."""
    s = F.col("status")
    rank = F.when(s.isin("late", "closing-soon", "changed", "start-now"), 0).when(s == "still-to-do", 1).when(s == "upcoming", 2).when(s == "snoozed", 3)
    when = F.when(rank == 2, F.col("start")).otherwise(F.col("target"))
    return rows.where(rank.isNotNull()).groupBy(person).agg(F.min(F.struct(rank.alias("rank"), when.alias("when"), "ord", "task", "status")).alias("n")).select(person, "n.task", "n.status", "n.when")


#: What stands before a task in the title of its event. Fixed values.
TITLES = {"opens": "Start: ", "changes": "Changes: ", "last": "Last day: ", "aim": "Aim for: ", "leave": "Before you leave: "}


def desired_events(rows: DataFrame, today: Column, excluded: Column | None = None) -> DataFrame:
    """Rows times their events: moment, title, date and alarms (days before), on or after today; alarms that are still ahead. Done and
    skipped tasks have none, nor have those that are ``excluded`` (an expression: by task, by category, or kept off calendars)."""
    firm, soft = F.array(*map(F.lit, FIRM_ALARMS)), F.array(*map(F.lit, SOFT_ALARMS))
    is_soft, away, last = F.col("kind") == "soft", F.col("status") == "after-you-leave", shown_end(today)
    event = lambda moment, date, alarms: F.struct(F.lit(moment).alias("moment"), F.concat(F.lit(TITLES[moment]), "task").alias("title"), date.alias("date"), alarms.alias("alarms"))
    none = F.array().cast("array<int>")
    aim = F.when(F.col("target") >= today, F.col("target")).otherwise(last)
    asleep = F.when(F.col("fitted") & ~F.col("cannot_fit"), F.least("until", "end")).otherwise(F.col("until"))
    events = F.array(
        F.when(away, event("leave", last, F.when(is_soft, soft).otherwise(firm))),
        F.when(~away & is_soft, event("aim", F.when(F.col("status") == "snoozed", asleep).otherwise(aim), soft)),
        F.when(~away & ~is_soft & (F.col("start") > today), event("opens", F.col("start"), none)),
        F.when(~away & ~is_soft & F.col("final_end").isNotNull(), event("changes", last, firm)),
        F.when(~away & ~is_soft, event("last", F.coalesce(F.col("final_end"), last), firm)),
    )
    wanted = rows.where(~F.col("status").isin("done", "skipped"))
    wanted = wanted if excluded is None else wanted.where(~F.coalesce(excluded, F.lit(False)))
    out = wanted.withColumn("_e", F.explode(F.array_compact(events))).select("*", "_e.*").drop("_e")
    ahead = F.filter("alarms", lambda d: F.date_sub(F.col("date"), d) > today)
    return out.where(F.col("date") >= today).withColumn("alarms", ahead)


KEY = ("person", "task", "moment", "date")


def stale_events(record: DataFrame, desired: DataFrame, today: Column) -> DataFrame:
    """Events of the record after today that aren't desired any more."""
    return record.where(F.col("date") > today).join(desired, list(KEY), "left_anti")


def missing_events(record: DataFrame, desired: DataFrame) -> DataFrame:
    """Desired events that the record doesn't have."""
    return desired.join(record, list(KEY), "left_anti")


def merged_record(record: DataFrame, events: DataFrame, added_on: Column, today: Column) -> DataFrame:
    """The record without what is past, and unseen events with the day they were added; of equal ones the record's stays."""
    return record.where(F.col("date") >= today).unionByName(missing_events(record, events).withColumn("added_on", added_on))


def strict_day(text: Column) -> Column:
    """A date from YYYY-MM-DD within 1900 to 2200; null for everything else."""
    day = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.when(F.year(day).between(1900, 2200) & (F.date_format(day, "yyyy-MM-dd") == text), day)


def day_fault(text: Column) -> Column:
    """Why a text is no date: format, year, month or day; null if it is one."""
    year, month = F.substring(text, 1, 4), F.substring(text, 6, 2)
    return (
        F.when(~F.coalesce(text, F.lit("")).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "format")
        .when(~year.between("1900", "2200"), "year")
        .when(~month.between("01", "12"), "month")
        .when(strict_day(text).isNull(), "day")
    )


def shown_day(day: Column) -> Column:
    return F.date_format(day, "MMM d, yyyy")


def event_uid(task: Column, moment: Column, host: str = "plan.example") -> Column:
    """A calendar's name for an event: the task's for its last day, aim or leave, else of task and moment."""
    key = F.when(moment.isin("last", "aim", "leave"), task).otherwise(F.concat(task, F.lit(":"), moment))
    return F.concat(F.sha2(key, 256), F.lit(f"@{host}"))


def folded_line(line: Column, octets: int = 75) -> Column:
    """A calendar line cut to ``octets`` bytes at characters' bounds; what follows starts with a space."""

    def fold(lines: pd.Series) -> pd.Series:
        def one(text):
            if text is None or len(text.encode()) <= octets:
                return text
            parts, now, room = [], "", octets
            for c in text:
                n = len(c.encode())
                if n > room:
                    parts.append(now)
                    now, room = "", octets - 1
                now, room = now + c, room - n
            return "\r\n ".join([*parts, now])

        return lines.map(one)

    return F.pandas_udf(fold, "string")(line)


def calendar(events: DataFrame, person: str, now: dt.datetime, product: str = "-//Quillspark//Plans//EN") -> DataFrame:
    """(person, text): an iCalendar text of the person's events (task, moment, title, date, alarms) in the order of date, task and
    moment, made at ``now`` (UTC); alarms at nine o'clock, lines folded, values escaped. A calendar is one row, as a plan has few
    events."""
    sequence = int(now.replace(tzinfo=dt.UTC).timestamp()) - VERSION_EPOCH
    title = calendar_escaped(F.col("title"))
    line = lambda name, value: folded_line(F.concat(F.lit(f"{name}:"), value))
    lined = events.select(person, "date", "task", "moment", "alarms", line("UID", event_uid(F.col("task"), F.col("moment"))).alias("uid"), line("SUMMARY", title).alias("summary"), line("DESCRIPTION", title).alias("description"))
    end = "\r\n"
    day = lambda c: F.date_format(c, "yyyyMMdd")
    alarm = lambda d: F.concat(F.lit(f"BEGIN:VALARM{end}ACTION:DISPLAY{end}"), F.col("description"), F.lit(f"{end}TRIGGER:"), alarm_trigger(d), F.lit(f"{end}END:VALARM{end}"))
    body = F.concat(
        F.lit(f"BEGIN:VEVENT{end}"), F.col("uid"), F.lit(f"{end}DTSTAMP:{now:%Y%m%dT%H%M%SZ}{end}SEQUENCE:{sequence}{end}DTSTART;VALUE=DATE:"), day("date"),
        F.lit(f"{end}DTEND;VALUE=DATE:"), day(F.date_add("date", 1)), F.lit(end), F.col("summary"), F.lit(end), F.array_join(F.transform("alarms", alarm), ""), F.lit(f"END:VEVENT{end}"),
    )
    listed = lined.select(person, F.struct("date", "task", "moment", body.alias("body")).alias("e")).groupBy(person).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return listed.select(person, F.concat(F.lit(f"BEGIN:VCALENDAR{end}VERSION:2.0{end}PRODID:{product}{end}CALSCALE:GREGORIAN{end}"), F.array_join("e.body", ""), F.lit(f"END:VCALENDAR{end}")).alias("text"))
