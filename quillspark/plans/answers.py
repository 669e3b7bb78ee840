"""Queries over answers: conversations as questions, their replies as cards of passages, measured and gated as a whole."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, acronyms, cited_ids
from ..operators import answers as A
from ..operators.common import spread, table
from .passages import _S

LEAD, SHORT = 40, 15
FLOORS = {"answered": 0.3, "expanded": 0.6, "in_top": 0.5, "rendered": 0.9}


def short(text: Column) -> Column:
    """A selection that SQL can tell: the first words."""
    return A.first_words(text, SHORT)


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as passages: each third has a section that its text starts with."""
    c = spread(table(spark, sf_dir, "conversations").where("role = 'assistant'"))
    section = F.when(F.col("conv_id") % 3 == 0, A.first_words(F.col("text"), 2)).when(F.col("conv_id") % 3 == 1, F.lit("If so"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", F.concat(F.lit("s"), (F.col("conv_id") % 7).cast("string")).alias("source"), section.alias("section"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A question for each conversation with replies and a second accepted answer for some. The snippet is five words of its first reply, from
    anywhere; each fifth question has none, each fourth another source."""
    p = _passages(spark, sf_dir)
    first = p.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("_n = 1")
    words = F.filter(F.split("text", f"[{SPACES}]+"), lambda w: w != "")
    at = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") % 13).otherwise(F.col("conv_id") * 31 % F.greatest(F.size(words), F.lit(1)))
    snippet = F.translate(F.array_join(F.slice(words, (at + 1).cast("int"), F.lit(5)), "  - "), ascii_lowercase, ascii_uppercase)
    k = F.col("conv_id")
    source = F.when(k % 4 == 3, F.lit("s9")).otherwise(F.col("source"))
    questions = first.select(k.alias("query"), source.alias("source"), F.when(k % 5 != 4, snippet).alias("snippet"))
    return questions, first.where(k % 6 == 2).select((k + 1).alias("query"), "source", snippet.alias("snippet"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of a question: the replies of its conversation and of the next one, ranked by a rule; each seventh question has none."""
    p = _passages(spark, sf_dir).withColumnRenamed("text", "excerpt")
    both = p.withColumn("query", F.explode(F.array("conv_id", F.col("conv_id") + 1))).where("query % 7 <> 6")
    return A.ranked_cards(both.withColumn("score", F.col("turn") * 7 % 5 + (F.col("conv_id") == F.col("query")).cast("int"))).drop("score")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question's answer and cards hold."""
    return A.answer_rows(*_questions(spark, sf_dir), _cards(spark, sf_dir), LEAD, short)


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, paired comparisons and lengths over all questions."""
    m = A.answer_measures(rows(spark, sf_dir), LEAD)
    return m.withColumns({c: F.round(c, 9) for c in m.columns if c.endswith("_p")})


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the run doesn't pass: one bar of two ways, floors, long answers and junk."""
    m = A.answer_measures(rows(spark, sf_dir), SHORT - 1)
    return A.gate_failures(m, FLOORS, 3, SHORT - 1, {"tier1_head": False, "experience_card": True})


def rows_by_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question's answer holds if it is selected by whole sentences, as it is shown."""
    return A.answer_rows(*_questions(spark, sf_dir), _cards(spark, sf_dir))


def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer taken from the first card, and what it cites."""
    e = A.extractive(_cards(spark, sf_dir), short)
    return e.select("query", "text", F.sha2("passage", 256).alias("passage"), "source", "id", "section")


def junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk and broken rules in answers of passages, some of which carry what they mustn't."""
    k = F.col("id") % 9
    text = F.when(k == 0, F.concat(F.lit("Links   page 3 "), "text")).when(k == 1, F.concat(F.lit("QUIZ TRUE FALSE "), "text")).when(k == 2, F.lit("Related Articles")).when(k == 3, F.concat(F.lit("PG 4 Module 2 "), "text")).when(k == 4, F.concat(F.lit("Unless "), "text")).otherwise(F.col("text"))
    return A.junk(_passages(spark, sf_dir).withColumn("text", text), short)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How selection does if it is given the passage that holds the answer."""
    questions, _ = _questions(spark, sf_dir)
    return A.selection_given_passage(questions, _passages(spark, sf_dir).withColumn("ord", -F.col("id")), short)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written answers with their verified citations, inert tokens and disclaimer: turns as prose that cites three ids, one of them unknown."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    prose = F.concat("text", F.lit(" [a1] see www.example.org/x, call +1 (555) 010-9999 or @help_desk [NATO] ["), F.when(k % 2 == 0, "b2").otherwise("zz"), F.lit("]."), F.when(k % 3 == 0, " AI generated – Verify against the official sources").otherwise(""))
    retrieved = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f"https://x/{i}").alias("url"), F.lit(i.upper()).alias("title")) for i in ("c3", "b2", "a1")])
    printed = acronyms(F.lit("the [NATO] map"))
    a = c.select("conv_id", "turn", A.cited_answer(prose, cited_ids(prose, printed), retrieved, printed).alias("a"))
    tail = F.slice("a.inert", F.size("a.inert") - F.when(F.size("a.inert") > 3, 3).otherwise(F.size("a.inert")) + 1, 3)
    return a.select("conv_id", "turn", F.sha2("a.text", 256).alias("text"), F.array_join("a.citations.id", ",").alias("cited"), F.array_join(F.array_sort(tail), " ").alias("inert"), "a.disclaimer")


QUERIES = {f"answers_{f.__name__}": f for f in (rows, measures, failures, rows_by_sentences, extracts, junk, selection, citations)}

_FIRST = lambda t, n: f"array_to_string(string_split_regex({t}, '[ \\t\\n\\x0B\\f\\r]+')[1:{n}], ' ')"
_FOLD = lambda t: f"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_ECHO = lambda t, s: f"CASE WHEN length({s}) > 0 AND starts_with({t}, {s}) AND NOT regexp_matches(substr({t}, length({s}) + 1), '^[A-Za-z0-9]') AND NOT regexp_matches({s}, '^(?i:if|unless)([^A-Za-z0-9_]|$)') THEN regexp_replace(substr({t}, length({s}) + 1), '^[\\t\\n\\x0b\\f\\r \\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}:.\\-]+', '') ELSE {t} END"
_PASSAGES = f"passages AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, 's' || (conv_id % 7) AS source, CASE WHEN conv_id % 3 = 0 THEN {_FIRST('text', 2)} WHEN conv_id % 3 = 1 THEN 'If so' END AS section, text FROM conversations WHERE role = 'assistant')"
_QUESTIONS = f"""{_PASSAGES}, first AS (SELECT *, list_filter(string_split_regex(text, '[{_S}]+'), lambda w: w <> '') AS w FROM passages QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
cut AS (SELECT *, translate(array_to_string(w[CASE WHEN conv_id % 2 = 0 THEN conv_id % 13 ELSE conv_id * 31 % greatest(len(w), 1) END + 1 : CASE WHEN conv_id % 2 = 0 THEN conv_id % 13 ELSE conv_id * 31 % greatest(len(w), 1) END + 5], '  - '), '{ascii_lowercase}', '{ascii_uppercase}') AS snippet FROM first),
questions AS (SELECT conv_id AS query, CASE WHEN conv_id % 4 = 3 THEN 's9' ELSE source END AS source, snippet FROM cut WHERE conv_id % 5 <> 4 AND snippet <> '')"""
_CARDS = "cards AS (SELECT p.*, q.query, row_number() OVER (PARTITION BY q.query ORDER BY turn * 7 % 5 + (conv_id = q.query)::INT DESC, id) AS rank FROM passages p, LATERAL (SELECT unnest([conv_id, conv_id + 1]) AS query) q WHERE q.query % 7 <> 6)"
_ROWS = f"""{_QUESTIONS}, {_CARDS},
needles AS (SELECT DISTINCT query, source, {_FOLD('snippet')} AS needle FROM (SELECT * FROM questions UNION ALL SELECT conv_id + 1, source, snippet FROM cut WHERE conv_id % 6 = 2 AND conv_id + 1 IN (SELECT query FROM questions))),
texts AS (SELECT query, rank, source, text AS excerpt, {_ECHO('text', "coalesce(section, '')")} AS passage FROM cards WHERE query IN (SELECT query FROM questions)),
chosen AS (SELECT *, {_FIRST('passage', SHORT)} AS answer FROM texts), sized AS (SELECT *, len(list_filter(string_split_regex(answer, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS budget FROM chosen),
surfaces AS (SELECT query, rank, source, budget, unnest(['answered', 'expanded', 'baseline', 'head_same', 'head_lead', 'held']) AS what, unnest([answer, passage, {_FIRST('excerpt', LEAD)}, {_FIRST('passage', 'budget')}, {_FIRST('excerpt', 'budget')}, excerpt]) AS hay FROM sized),
hits AS (SELECT s.query, rank, what, budget, bool_or(coalesce(needle <> '' AND contains({_FOLD('hay')}, needle), false)) AS hit FROM surfaces s LEFT JOIN needles n ON n.query = s.query AND n.source = s.source GROUP BY ALL),
flat AS (SELECT query, rank, any_value(budget) AS budget, bool_or(hit AND what = 'answered') AS answered, bool_or(hit AND what = 'expanded') AS expanded, bool_or(hit AND what = 'baseline') AS baseline, bool_or(hit AND what = 'head_same') AS head_same, bool_or(hit AND what = 'head_lead') AS head_lead, bool_or(hit AND what = 'held') AS held FROM hits GROUP BY query, rank),
told AS (SELECT q.query, any_value(budget) FILTER (rank = 1) AS length, {", ".join(f"coalesce(bool_or({c}) FILTER (rank = 1), false) AS {c}" for c in ("answered", "expanded", "baseline", "head_same", "head_lead"))},
  coalesce(bool_or(held), false) AS in_top, coalesce(bool_or(held AND answered), false) AS best_card, coalesce(min(rank) FILTER (held) > 1, false) AND NOT coalesce(bool_or(answered) FILTER (rank = 1), false) AS buried FROM questions q LEFT JOIN flat f USING (query) GROUP BY q.query)"""
_SIGN = lambda b, c: f"CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) + ({b} + {c}) * ln(0.5))))) END"
_PAIRED = ", ".join(f"count(*) FILTER ({x} AND NOT {y}) AS {p}_{s}" for p, (a, b) in A.PAIRS.items() for s, x, y in (("gained", a, b), ("lost", b, a)))
_LENGTHS = "l AS (SELECT list_sort(list(length)) AS l FROM told WHERE length IS NOT NULL)"
_MEASURED = f"m AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in A.COUNTS)}, {_PAIRED}, count(length) AS rendered FROM told)"
_SHARE = lambda c, f: f"CASE WHEN {c} / n < {f} THEN '{c}: ' || printf('%.1f', 100.0 * {c} / n) || '% is below the floor of {f * 100:.1f}%' END"
_BAR = lambda p, sure: f"CASE WHEN {p}_gained <= {p}_lost THEN '{p}: direction'" + (f" WHEN {_SIGN(f'{p}_gained', f'{p}_lost')} >= 0.05 THEN '{p}: significance'" if sure else "") + " END"

ORACLES = {
    "answers_rows": f"WITH {_ROWS} SELECT query, length::INT AS length, answered, expanded, baseline, head_same, head_lead, in_top, best_card, buried FROM told",
    "answers_measures": f"WITH {_ROWS}, {_LENGTHS}, {_MEASURED} SELECT m.*, l[len(l)]::INT AS longest, len(list_filter(l, lambda x: x > {LEAD}))::BIGINT AS over_card, l[(len(l) * 0.5)::DOUBLE::INT + 1]::INT AS median, l[floor(len(l) * 0.9)::INT + 1]::INT AS p90, {', '.join(f'round({_SIGN(f"{p}_gained", f"{p}_lost")}, 9) AS {p}_p' for p in A.PAIRS)} FROM m, l".replace("(len(l) * 0.5)::DOUBLE::INT", "floor(len(l) * 0.5)::INT"),
    "answers_failures": f"WITH {_ROWS}, {_LENGTHS}, {_MEASURED}, o AS (SELECT len(list_filter(l, lambda x: x > {SHORT - 1})) AS o FROM l), f AS (SELECT unnest(range(0, 8))::INT AS nth, unnest([{_BAR('tier1_head', False)}, {_BAR('experience_card', True)}, {', '.join(_SHARE(c, f) for c, f in FLOORS.items())}, CASE WHEN o > 0 THEN o || ' answers are longer than the {SHORT - 1}-word card' END, '3 passages carry junk in the selected answer']) AS failure FROM m, o) SELECT * FROM f WHERE failure IS NOT NULL",
    "answers_extracts": f"WITH {_PASSAGES}, {_CARDS}, p AS (SELECT *, {_ECHO('text', "coalesce(section, '')")} AS passage FROM cards WHERE rank = 1) SELECT query, {_FIRST('passage', SHORT)} AS text, sha256(passage) AS passage, source, id, section FROM p",
}
