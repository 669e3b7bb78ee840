"""Queries of the rules over questions, answers, requests, plans and limits. Texts of the tables carry made-up phrases, one of a list
by their number, so that every rule meets what it is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import text as T
from ..operators import rules as R
from ..operators.common import table

#: Made-up phrases.
QUESTIONS = (
    "how do I file", "I want to die", "is he suicidal", "what does my rating pay", "can I still keep my pay", "does it cost me my account", "I cannot go on", "there is no reason to go on", "who may bar us",
    "the office opens at nine", "put in for it", "are we eligible", "that is mine", "don't want to be here", "Module 1 of the guide",
)
ANSWERS = (
    "call 988 now", "in 1988 there were 29881", "see www.va.gov/claims", "1-800-827-1000 is open", "the Crisis Line answers", "Related Articles", " browse by topic ", "If you served", "QUIZ TRUE FALSE", "see Page 3 Module 2",
    "true false TRUE FALSE True False ", "Module Question Number Answer", "text 838255", "unless it rains", "nothing here",
)
SECTIONS = ("If you moved", "Overview", None, "unless told", "iffy matters")


def pick(items: tuple, k: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in items]), (k % len(items)).cast("int"))


def _pick_sql(items: tuple, k: str) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in items) + f"][1 + ({k}) % {len(items)}]"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 3 + F.col("turn")
    return c.select("conv_id", "turn", k.alias("k"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select("conv_id", "turn", F.concat_ws(" ", pick(QUESTIONS, F.col("k")), "text").alias("q"))
    return t.select("conv_id", "turn", D.asks_in_crisis(F.col("q")).alias("crisis"), D.asks_of_eligibility(F.col("q")).alias("eligibility"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers name, which rules of form they break, and what of them must not become a link."""
    t = _turns(spark, sf_dir).withColumn("a", F.when(F.col("k") % 2 == 0, pick(ANSWERS, F.col("k"))).otherwise(F.concat_ws(" ", pick(ANSWERS, F.col("k")), "text")))
    s = pick(SECTIONS, F.col("turn"))
    return t.select("conv_id", "turn", D.names_crisis_line(F.col("a")).alias("line"), D.names_fallback(F.col("a")).alias("fallback"), F.array_join(D.violated(F.col("a"), s), ",").alias("violated"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What written answers come to and what is shown of them, over all combinations that the order numbers give."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cited = F.filter(F.array(F.when(k % 3 != 0, F.lit("a")), F.when(k % 5 == 0, F.lit("z"))), lambda x: x.isNotNull())
    stop = F.when(k % 11 == 0, "refusal").when(k % 13 == 0, "max_tokens").otherwise("end")
    text = pick(ANSWERS, k)
    kind = D.outcome(stop, cited, F.array(F.lit("a"), F.lit("b")), text, F.when(k % 7 == 0, F.array(F.lit("9"))).otherwise(F.array().cast("array<string>")))
    view = pick(("answer", "refusal", "unavailable", "notCovered", "eligibility", None, "cutShort", "degraded"), F.floor(k / 4))
    shown = D.shown_answer(k % 2 == 0, D.view_of(view), F.when(k % 3 == 0, "text").when(k % 3 == 1, ""))
    return o.select("o_orderkey", kind.alias("kind"), shown["kind"].alias("shown"), shown["note"].alias("note"))


METHODS, ORIGINS, RAW = ("POST", "GET", "POST", "POST"), ("https://a.example", "https://b.example", None, "https://a.example"), ("what is due", "  ", None, "when", "where to go")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests get, what the client then does, and where it goes on after failures."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = D.retrieval_status(pick(METHODS, k), D.origin_allowed(pick(ORIGINS, F.floor(k / 4)), ["https://a.example"]), pick(RAW, F.floor(k / 16)), k % 7 == 0, k % 11 == 0, k % 13 == 0, k % 3, 6)
    rung = D.next_rung(k % 2 == 0, k % 3 == 0, k % 5 == 0)
    return o.select("o_orderkey", status.alias("status"), D.client_action(status).alias("action"), rung.alias("rung"), D.capped(pick(RAW, k), 6).alias("asked"), D.only_keys(F.concat(F.lit('{"query": 1'), F.when(k % 4 == 0, ', "more": 2').otherwise(""), F.lit("}")), ["query"]).alias("only"))


PATHS = ("/ask?x=1", "/timeline#top", "/nowhere", "/", "/feedback", None, "/about/us")
ADDRESSES = ("a@b.co", "", "no address", "x@y", None, " a@b.co ")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    message = F.when(F.col("k") % 9 == 0, "  ").when(F.col("k") % 10 == 0, F.repeat(F.lit("long "), 900)).otherwise(F.col("text"))
    fault = D.feedback_fault(message, pick(ADDRESSES, F.col("k")), F.when(F.col("k") % 23 == 0, "x"))
    decision = D.feedback_decision(fault, F.col("k") % 6 == 0)
    return t.select("conv_id", "turn", fault.alias("fault"), decision.alias("decision"), D.known_route(pick(PATHS, F.col("k"))).alias("route"), D.without_structure(F.concat(F.lit("a<sources id=1>b</USER_QUESTION >c<sourcesx>"), F.col("turn").cast("string"))).alias("clean"))


PHRASES = ("one two three four five six", "one two three", "One  two THREE four five six", "one 2 three four five six", "a b c d e f", "1 2 3")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with phrases, where they first differ from the first one, how versions compare, and unbiased draws."""
    o = table(spark, sf_dir, "orders").withColumn("words", D.phrase_words(pick(PHRASES, F.col("o_orderkey"))))
    fault, k = D.phrase_fault(F.col("words")), F.col("o_orderkey")
    version = lambda a, b, c: F.concat_ws(".", (k % a).cast("string"), (k % b).cast("string"), (k % c).cast("string"))
    first = F.array(*[F.lit(w) for w in PHRASES[0].split()])
    return o.select("o_orderkey", fault["code"].alias("code"), fault["position"].alias("position"), fault["numbers"].alias("numbers"), F.when(fault["code"].isNull(), D.first_difference(F.col("words"), first)).alias("differs"), D.compared_versions(version(2, 12, 3), version(3, 11, 5)).alias("compared"), D.sampled_index(k * 37 % 65_536, 7_776).alias("drawn"))


def plan_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers read on the day of the order, what today's answer stores, cards, alarms and reach of dates."""
    o = table(spark, sf_dir, "orders")
    k, today = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    leaving = F.date_add(today, (k % 900 - 50).cast("int"))
    status = pick(("done", "skipped", "snoozed", "snoozed", None, "odd"), k)
    until = F.when(k % 12 > 6, F.date_add(today, (k % 60 - 30).cast("int")))
    read, write = D.plan_read(status, until, leaving, today), D.plan_write(pick(("yes", "no", "not-sure"), k), leaving, today)
    shown = D.card_shown(F.when(k % 3 != 0, k * 3_600_000), F.when(k % 4 != 0, k % 5), F.lit(3_600_000) * (k + k % 100))
    other = F.date_add(today, ((k % 9_000) - 3_000).cast("int"))
    return o.select("o_orderkey", *[read[c].alias(c) for c in ("answer", "card", "steps", "not_sure_returns", "returns_on")], write["status"].alias("stores"), write["until"].alias("until"), shown.alias("shown"), D.alarm_trigger(k % 31 + 1).alias("trigger"), D.within_reach(other, today).alias("reach"), D.days_left(leaving, today).cast("long").alias("left"))


def served_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    record = F.when(
        k % 10 != 0,
        F.struct(
            F.when(k % 7 == 0, "old").otherwise("hash").alias("capture_hash"), F.when(k % 11 == 0, 1).otherwise(2).alias("derivation_version"),
            F.create_map(F.when(k % 13 == 0, "0").otherwise("1"), (k % 5).cast("int"), F.lit("12"), F.lit(3)).alias("kept_per_page"),
            F.array(F.lit(1), (k % 6).cast("int")).alias("darkened_pages"), (k % 17 - 1).alias("removed"), (k % 110).alias("quality"), F.lit(5).alias("max_pixels"),
        ),
    )
    served = D.served_fault(k % 3 != 0, k % 4 != 0, k * 300_000)
    opens = D.opens_right_page(F.when(k % 9 != 0, "/docs/a"), F.lit("/docs/a"), (k % 40).cast("int"), F.lit(30))
    return p.select("p_partkey", D.record_fault(record, F.lit("hash"), F.lit(2)).alias("record"), served.alias("served"), opens.alias("opens"), D.build_landed(F.concat(F.lit('{"version":"'), k.cast("string"), F.when(k % 5 == 0, "x").otherwise(""), F.lit('"}')), F.lit(100)).alias("landed"), D.answer_health(F.when(k % 6 == 0, 500).otherwise(200), F.when(k % 7 == 0, "empty").otherwise("results"), F.when(k % 8 == 0, "0.9").otherwise("1.0"), "1.0").alias("health"))


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven lines of limits for each supplier."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("line"))
    k = F.col("s_suppkey") * 7 + F.col("line")
    raised = F.when(k % 3 == 0, 500 + k % 90)
    return s.select("s_suppkey", "line", (F.col("line") == 2).alias("counted"), (k % 1000).cast("long").alias("base"), F.lit(1500).cast("long").alias("limit"), raised.cast("long").alias("raised"), (k * 31 % 1990).cast("long").alias("measured"), (1500 + k % 400).cast("long").alias("current"))


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.limit_plan(_limits(spark, sf_dir), "s_suppkey").select("s_suppkey", "line", "allowed", "need", "refused", "ok", "to")
    b = R.final_plan(_limits(spark, sf_dir), "s_suppkey").select("s_suppkey", "line", F.col("ok").alias("final_ok"), F.col("to").alias("final_to"))
    return a.join(b, ["s_suppkey", "line"])


def greatest_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.greatest_of(_limits(spark, sf_dir), ("base", "measured", "current"))


def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of customers' segments and part names but those of brands, in order."""
    p = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).where("word rlike '^[a-z]+$'").distinct()
    gone = p.where("length(word) > 12 OR word LIKE 's%'")
    return R.curated(p, gone, 1)


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of lines that should be a number, a tab and a word, and of removals with their reasons."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    lines = c.select("c_custkey", F.concat(k.cast("string"), F.when(k % 9 == 0, " ").otherwise("\t"), F.concat(F.lit("word"), (k % 1001).cast("string")), F.when(k % 14 == 0, "\t").otherwise("")).alias("line"))
    return R.word_faults(lines, "line").select("c_custkey", "fault")


def removal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("w"), (F.col("c_custkey") % 1201).cast("string")).alias("word"), pick(("rude", "close", "odd"), F.col("c_custkey")).alias("reason"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("w"), (F.col("s_suppkey") * 13 % 1201).cast("string")).alias("word"))
    return R.removal_faults(c, known, ("rude", "close")).select("c_custkey", "fault")


def replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held paths that a made-up build has replaced."""
    held = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/docs/d"), (F.col("c_custkey") % 40).cast("string"), F.lit("."), F.left(F.sha2(F.col("c_custkey").cast("string"), 256), F.lit(16)), F.lit(".pdf"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("/models/m"), (F.col("c_custkey") % 50).cast("string"))).otherwise(F.concat(F.lit("/else/"), F.col("c_custkey").cast("string"))).alias("path"))
    shipped = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/docs/d"), (F.col("s_suppkey") % 30).cast("string"), F.lit(".0123456789abcdef.pdf"))).otherwise(F.concat(F.lit("/models/m"), (F.col("s_suppkey") % 20).cast("string"))).alias("path"))
    return R.superseded(held, shipped, ("/docs/", "/models/", "/none/"), ("/docs/",))


def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each event five hours west, and to where the three snoozes of that day reach."""
    e = table(spark, sf_dir, "events").select("event_id", D.local_day(F.col("ts").cast("timestamp"), "-05:00").alias("day"))
    return e.select("event_id", "day", *[D.snoozed_until(F.col("day"), n).alias(f"until_{n}") for n in D.SNOOZES])


#: Lines as they are shown beside tasks: what makes a claim about the reader, and what doesn't.
CLAIMS = ("You may qualify for it.", "You’ll get a letter.", "You have up to 30 more days.", "it is guaranteed", "You will likely be approved.", "Your command may approve it.", "Who will approve your leave?", "Ask whether your request is approved.", "Members get it.", "You apply.")


def personal_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns make a claim about their reader: each with a line put behind it by turns."""
    c = table(spark, sf_dir, "conversations")
    line = F.get(F.array(*map(F.lit, CLAIMS)), ((F.col("conv_id") + F.col("turn")) % len(CLAIMS)).cast("int"))
    return c.select("conv_id", "turn", D.claims_personally(F.concat("text", F.lit(". "), line)).alias("claims"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replies of the service count as: documents as replies, their language as status for some."""
    k = F.col("doc_id")
    status = F.when(k % 5 == 0, "results").when(k % 5 == 1, "empty").when(k % 5 == 2, "high_demand").when(k % 5 == 3, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", D.handshake(status, F.when(k % 7 != 6, F.when(k % 3 == 0, "2").otherwise("1")), "1", F.when(k % 11 != 0, F.length("text") > 500)).alias("reply"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all customers have an order, and all orders a customer."""
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    both = [R.placement(c, o, "key").withColumn("of", F.lit("customers")), R.placement(o, c, "key").withColumn("of", F.lit("orders"))]
    return both[0].unionByName(both[1])


QUERIES = {f"rules_{f.__name__}": f for f in (questions, answers, outcomes, requests, feedback, phrases, plan_answers, served_files, limits, greatest_limits, word_list, word_lines, removal_lines, replaced_files, local_days, personal_claims, replies, placements)}

_S = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def _re(p: str) -> str:
    """A pattern for DuckDB: white space spelled out, quotes doubled."""
    out, inside, i = [], False, 0
    while i < len(p):
        two = p[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(_S if inside else f"[{_S}]" if two == r"\s" else f"[^{_S}]")
        elif p[i] == "\\":
            out.append(two)
        else:
            inside = p[i] == "[" or inside and p[i] != "]"
            out.append(p[i])
            i += 1
            continue
        i += 2
    return "".join(out).replace("'", "''")


def _any(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?i){_re(p)}')" for p in patterns) + ")"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_S}]+|[{_S}]+$', '', 'g')"


def _line(c: str) -> str:
    return f"(regexp_matches({c}, '(^|[^0-9])988([^0-9]|$)') OR contains(lower({c}), '838255') OR contains(lower({c}), 'veteranscrisisline.net') OR contains(lower({c}), 'crisis line'))"


def _fallback(c: str) -> str:
    return f"(contains(lower({c}), '1-800-827-1000') OR contains(lower({c}), 'va.gov'))"


_K = "conv_id * 3 + turn"
_MARGIN = "CASE WHEN line = 2 THEN 0 ELSE ceil(greatest(0, measured - base) * 0.1::DECIMAL(2,1))::BIGINT END"
_LIMITS = f"l AS (SELECT s_suppkey, i AS line, (s_suppkey * 7 + i) % 1000 AS base, CASE WHEN (s_suppkey * 7 + i) % 3 = 0 THEN 500 + (s_suppkey * 7 + i) % 90 END AS raised, (s_suppkey * 7 + i) * 31 % 1990 AS measured, 1500 + (s_suppkey * 7 + i) % 400 AS current FROM supplier, range(7) r(i)), m AS (SELECT *, {_MARGIN} AS spare, CASE WHEN raised > 0 THEN 1500 + raised ELSE current END AS allowed FROM l)"

ORACLES = {
    "rules_questions": f"WITH q AS (SELECT conv_id, turn, {_pick_sql(QUESTIONS, _K)} || ' ' || text AS q FROM conversations) SELECT conv_id, turn, {_any('q', *D.CRISIS)} AS crisis, {_any('q', D.PERSON)} AND {_any('q', *D.ELIGIBILITY)} AS eligibility FROM q",
    "rules_answers": f"WITH a AS (SELECT conv_id, turn, CASE WHEN ({_K}) % 2 = 0 THEN {_pick_sql(ANSWERS, _K)} ELSE {_pick_sql(ANSWERS, _K)} || ' ' || text END AS a, {_pick_sql(SECTIONS, 'turn')} AS s FROM conversations), b AS (SELECT *, {_trim('a')} AS t FROM a) SELECT conv_id, turn, {_line('a')} AS line, {_fallback('a')} AS fallback, concat_ws(',', CASE WHEN {_any('s', D.CONDITION)} AND NOT {_any('t', D.CONDITION)} THEN 'condition-attached' END, CASE WHEN {_any('a', *D.QUIZ)} THEN 'no-graded-exercise' END, CASE WHEN lower(t) IN {D.CHROME} THEN 'no-page-chrome' END, CASE WHEN {_any('a', D.KEY_ROW)} THEN 'no-answer-key-row' END) AS violated FROM b",
    "rules_outcomes": f"WITH o AS (SELECT o_orderkey, o_orderkey AS k, {_pick_sql(ANSWERS, 'o_orderkey')} AS t, o_orderkey % 3 <> 0 AS valid, o_orderkey % 5 = 0 AS wrong, {_pick_sql(('answer', 'refusal', 'unavailable', 'notCovered', 'eligibility', None, 'cutShort', 'unavailable'), 'o_orderkey // 4')} AS v, CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN '' END AS x FROM orders), g AS (SELECT *, k % 2 = 0 OR coalesce(v = 'eligibility', false) AS gate, coalesce(x <> '', false) AS has, CASE WHEN v = 'refusal' THEN 'refused' WHEN v IN ('unavailable', 'cutShort') THEN v WHEN (k % 2 = 0 OR v = 'eligibility') AND v = 'answer' THEN 'suppressed' END AS n FROM o) SELECT o_orderkey, CASE WHEN NOT valid AND {_line('t')} THEN 'crisis' WHEN k % 11 = 0 THEN 'serviceFailed' WHEN k % 13 = 0 THEN 'cutShort' WHEN NOT valid AND {_fallback('t')} THEN 'notCovered' WHEN wrong THEN 'invalid_citation' WHEN NOT valid THEN 'no_citations' WHEN k % 7 = 0 THEN 'ungrounded_number' ELSE 'answer' END AS kind, CASE WHEN gate THEN CASE WHEN has THEN 'extractive' ELSE 'eligibility' END WHEN v = 'notCovered' THEN 'notCovered' WHEN v = 'answer' THEN 'synthesized' WHEN has THEN 'extractive' END AS shown, CASE WHEN gate AND has THEN n WHEN gate OR v IN ('notCovered', 'answer') THEN NULL WHEN has THEN n END AS note FROM g",
    "rules_requests": f"WITH o AS (SELECT o_orderkey, o_orderkey AS k, {_pick_sql(METHODS, 'o_orderkey')} AS m, coalesce({_pick_sql(ORIGINS, 'o_orderkey // 4')} = 'https://a.example', false) AS ok, {_pick_sql(RAW, 'o_orderkey // 16')} AS q, {_pick_sql(RAW, 'o_orderkey')} AS r FROM orders), s AS (SELECT *, CASE WHEN m <> 'POST' THEN '405' WHEN NOT ok THEN '403' WHEN q IS NULL THEN 'error' WHEN trim(q) = '' THEN 'empty' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'high_demand' WHEN k % 13 = 0 THEN 'error' WHEN k % 3 = 0 THEN 'empty' ELSE 'results' END AS status FROM o) SELECT o_orderkey, status, CASE status WHEN 'results' THEN 'render' WHEN 'empty' THEN 'no_source' WHEN 'high_demand' THEN 'degrade' ELSE 'service_unavailable' END AS action, CASE WHEN k % 6 = 0 THEN 'outbound_hub' WHEN k % 2 = 0 THEN CASE WHEN k % 5 = 0 THEN 'offer_device' ELSE 'outbound_hub' END WHEN k % 3 = 0 THEN 'offer_online' ELSE 'outbound_hub' END AS rung, left(trim(r), 6) AS asked, k % 4 <> 0 AS only FROM s",
    "rules_feedback": f"WITH c AS (SELECT conv_id, turn, {_K} AS k, CASE WHEN ({_K}) % 9 = 0 THEN '  ' WHEN ({_K}) % 10 = 0 THEN repeat('long ', 900) ELSE text END AS m, {_pick_sql(ADDRESSES, _K)} AS a, {_pick_sql(PATHS, _K)} AS p FROM conversations), f AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'spam' WHEN {_trim('m')} = '' THEN 'empty' WHEN length({_trim('m')}) > 4000 THEN 'too_long' WHEN trim(coalesce(a, '')) <> '' AND NOT {_any('trim(a)', D.ADDRESS)} THEN 'bad_email' END AS fault FROM c) SELECT conv_id, turn, fault, CASE WHEN fault IS NOT NULL THEN 'reject' WHEN k % 6 = 0 THEN 'limited' ELSE 'send' END AS decision, CASE WHEN regexp_extract(p, '^[^?#]*') IN {D.ROUTES} THEN regexp_extract(p, '^[^?#]*') END AS route, 'a b c<sourcesx>' || turn AS clean FROM f",
    "rules_phrases": f"WITH o AS (SELECT o_orderkey, o_orderkey AS k, list_filter(string_split_regex(lower({_pick_sql(PHRASES, 'o_orderkey')}), ' +'), lambda w: w <> '') AS w FROM orders), f AS (SELECT *, list_position(list_transform(w, lambda x: regexp_full_match(x, '[a-z]+')), false) AS bad FROM o), c AS (SELECT *, CASE WHEN len(w) <> 6 THEN 'words' WHEN bad > 0 THEN 'letters' END AS code FROM f) SELECT o_orderkey, code, CASE WHEN code = 'letters' THEN bad END::INT AS position, CASE WHEN code = 'words' THEN len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) > 0 END AS numbers, CASE WHEN code IS NULL THEN nullif(coalesce(list_position(list_transform(range(1, 7), lambda i: w[i] = ['one', 'two', 'three', 'four', 'five', 'six'][i]), false), 0), 0) END::INT AS differs, CASE WHEN k % 2 <> k % 3 THEN sign(k % 2 - k % 3) WHEN k % 12 <> k % 11 THEN sign(k % 12 - k % 11) ELSE sign(k % 3 - k % 5) END::INT AS compared, CASE WHEN k * 37 % 65536 < 62208 THEN k * 37 % 65536 % 7776 END AS drawn FROM c",
    "rules_plan_answers": "WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderdate::DATE AS d, o_orderdate::DATE + (o_orderkey % 900 - 50)::INT AS l, ['done', 'skipped', 'snoozed', 'snoozed', NULL, 'odd'][1 + o_orderkey % 6] AS s, CASE WHEN o_orderkey % 12 > 6 THEN o_orderdate::DATE + (o_orderkey % 60 - 30)::INT END AS u, ['yes', 'no', 'not-sure'][1 + o_orderkey % 3] AS w, o_orderdate::DATE + (o_orderkey % 9000 - 3000)::INT AS x FROM orders), a AS (SELECT *, l - 456 AS again, d < l - 21 AS ask, coalesce(s = 'snoozed' AND u IS NOT NULL, false) AS early, CASE WHEN u IS NULL AND s = 'done' THEN 'yes' WHEN u IS NULL AND s = 'skipped' THEN 'no' WHEN s = 'snoozed' THEN 'not-sure' ELSE 'none' END AS answer FROM o), p AS (SELECT *, (d - INTERVAL 5 YEAR)::DATE + (month(d) = 2 AND day(d) = 29)::INT AS low, (d + INTERVAL 15 YEAR)::DATE + (month(d) = 2 AND day(d) = 29)::INT AS high FROM a) SELECT o_orderkey, answer, CASE WHEN early THEN CASE WHEN d >= least(u, again) AND ask THEN 'again' END WHEN answer = 'none' AND ask THEN 'first' END AS card, coalesce(u IS NULL AND s IN ('done', 'snoozed'), false) AS steps, CASE WHEN d < again THEN again END AS not_sure_returns, CASE WHEN early AND d < least(u, again) THEN least(u, again) END AS returns_on, CASE w WHEN 'yes' THEN 'done' WHEN 'no' THEN 'skipped' ELSE CASE WHEN d >= again THEN 'snoozed' END END AS stores, CASE WHEN w = 'not-sure' AND d < again THEN again END AS until, coalesce(CASE WHEN k % 4 <> 0 THEN k % 5 END, 0) < 3 AND (k % 3 = 0 OR k % 100 >= 72) AS shown, CASE WHEN k % 31 = 0 THEN '-PT15H' ELSE '-P' || (k % 31) || 'DT15H' END AS trigger, x BETWEEN low AND high AS reach, (l - d)::BIGINT AS \"left\" FROM p",
    "rules_served_files": "WITH p AS (SELECT p_partkey, p_partkey AS k FROM part) SELECT p_partkey, CASE WHEN k % 10 = 0 THEN 'no_record' WHEN k % 7 = 0 THEN 'stale' WHEN k % 11 = 0 THEN 'version' WHEN k % 13 = 0 OR k % 5 = 0 OR k % 6 <= 1 OR k % 17 = 0 OR k % 110 > 100 THEN 'bad_record' END AS record, CASE WHEN k % 3 = 0 THEN 'no_derivation' WHEN k % 4 = 0 THEN 'text_moved' WHEN k * 300000 > 26214400 THEN 'over_cap' END AS served, k % 9 <> 0 AND k % 40 BETWEEN 1 AND 30 AS opens, CASE WHEN k % 5 <> 0 THEN k >= 100 END AS landed, CASE WHEN k % 6 = 0 THEN 'http' WHEN k % 7 = 0 THEN 'no_results' WHEN k % 8 = 0 THEN 'version' END AS health FROM p",
    "rules_limits": f"WITH {_LIMITS}, a AS (SELECT *, measured > allowed AS refused, bool_or(measured > allowed) OVER w AS any_, bool_or(measured > current) OVER w AS final_, CASE WHEN raised > 0 THEN least(measured + spare, allowed) ELSE current END AS t FROM m WINDOW w AS (PARTITION BY s_suppkey)) SELECT s_suppkey, line::INT AS line, allowed, measured + spare AS need, refused, NOT any_ AS ok, CASE WHEN NOT any_ AND t > current THEN t END AS \"to\", NOT final_ AS final_ok, CASE WHEN NOT final_ AND raised > 0 AND current - measured > spare THEN measured + spare END AS final_to FROM a",
    "rules_greatest_limits": f"WITH {_LIMITS} SELECT max(base) AS base, max(measured) AS measured, max(current) AS current FROM l",
    "rules_word_list": "SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) WHERE regexp_full_match(word, '[a-z]+') AND length(word) <= 12 AND word NOT LIKE 's%'",
    "rules_word_lines": "WITH c AS (SELECT c_custkey, 'word' || (c_custkey % 1001) AS w, c_custkey % 9 = 0 OR c_custkey % 14 = 0 AS odd FROM customer), n AS (SELECT w, count(*) AS n FROM c WHERE NOT odd GROUP BY w) SELECT c_custkey, CASE WHEN odd THEN 'shape' WHEN n > 1 THEN 'repeat' END AS fault FROM c LEFT JOIN n USING (w)",
    "rules_removal_lines": "WITH c AS (SELECT c_custkey, 'w' || (c_custkey % 1201) AS w, count(*) OVER (PARTITION BY c_custkey % 1201) AS n FROM customer), k AS (SELECT DISTINCT 'w' || (s_suppkey * 13 % 1201) AS w FROM supplier) SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'reason' WHEN k.w IS NULL THEN 'unknown_word' WHEN n > 1 THEN 'duplicate' END AS fault FROM c LEFT JOIN k USING (w)",
    "rules_replaced_files": "WITH h AS (SELECT CASE c_custkey % 3 WHEN 0 THEN '/docs/d' || (c_custkey % 40) || '.' || left(sha256(c_custkey::VARCHAR), 16) || '.pdf' WHEN 1 THEN '/models/m' || (c_custkey % 50) ELSE '/else/' || c_custkey END AS path, CASE c_custkey % 3 WHEN 0 THEN '/docs/d' || (c_custkey % 40) WHEN 1 THEN '/models/m' || (c_custkey % 50) END AS key, c_custkey % 3 AS s FROM customer), n AS (SELECT CASE s_suppkey % 2 WHEN 0 THEN '/docs/d' || (s_suppkey % 30) ELSE '/models/m' || (s_suppkey % 20) END AS key FROM supplier) SELECT path FROM h WHERE s < 2 AND key NOT IN (SELECT key FROM n)",
    "rules_local_days": "WITH d AS (SELECT event_id, (ts - INTERVAL 5 HOUR)::DATE AS day FROM events) SELECT event_id, day, (day + 7)::DATE AS until_7, (day + 30)::DATE AS until_30, (day + 90)::DATE AS until_90 FROM d",
    "rules_personal_claims": "SELECT conv_id, turn, (conv_id + turn) % 10 IN (0, 1, 2, 3, 4, 5) OR regexp_matches(text, '(?i)\\byou(''re| are| may| might| could| will| would)?( be)? (qualif\\w*|eligible|entitled)\\b|\\byou(''ll| will| can)? (get|receive)\\b|\\bguarantee') AS claims FROM conversations",
    "rules_replies": "WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'results' WHEN 1 THEN 'empty' WHEN 2 THEN 'high_demand' WHEN 3 THEN lang END AS s, CASE WHEN doc_id % 7 <> 6 THEN doc_id % 3 <> 0 ELSE false END AS fits, doc_id % 11 <> 0 AND length(text) > 500 AS has FROM documents) SELECT doc_id, CASE WHEN s = 'results' AND fits AND has OR s = 'empty' AND fits OR s = 'high_demand' THEN s ELSE 'error' END AS reply FROM r",
    "rules_placements": "WITH g AS (SELECT 'customers' AS of, c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT 'orders', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) SELECT o.of, count(k) = 0 AS ok, count(k) AS missing, min(k) AS first FROM (VALUES ('customers'), ('orders')) AS o(of) LEFT JOIN g USING (of) GROUP BY o.of",
}
