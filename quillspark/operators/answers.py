"""Answers taken from retrieved cards, answers that cite, and how well they do over labelled questions.

Each question has its cards (query, rank, source, section, excerpt, ...) in the order of retrieval. The first one gives the answer. All
measures come from one row a question, which holds what its first card, its answer and all its cards contain; rates, paired
comparisons, lengths and failures are aggregates of those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import inert, violated
from ..functions.text import heading_stripped, without_citations
from .chunking import openings, shown_text
from .containment import containing
from .evaluation import ALPHA, at_places, bar_passed, sign_test

# ---- fixed values ----------------------------------------------------------------------------------------------------

DISCLAIMER = "AI-generated - verify against the official sources."
#: The model's own copy of it at the end of what it wrote.
COPY = r"(?i)\s*AI[- –—]generated\s*[-–—]?\s*verify against the official sources\.?\s*$"
#: A running header on a heading of links, in an answer.
JUNK = {"running header carried on a Links heading": r"Links\s*page\s*\d"}
LEAD_WORDS, PROBE = 120, 40

Select = Callable[[Column], Column]


def folded_words(text: Column) -> Column:
    """Lower case, letters a-z, digits and single spaces alone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), r"\s+", " "))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def first_words(text: Column, n: Column | int) -> Column:
    """The first ``n`` pieces between white space."""
    return F.array_join(F.slice(F.split(text, r"\s+"), F.lit(1), F.greatest(F.lit(0), n if isinstance(n, Column) else F.lit(n))), " ")


def extractive(cards: DataFrame, select: Select = openings) -> DataFrame:
    """The first card of each query with passage, its excerpt without a repeat of its section, and text, the short answer that
    is selected from it. The answer cites that card, whatever others hold."""
    passage = heading_stripped(F.col("excerpt"), F.coalesce("section", F.lit("")))
    return cards.where("rank = 1").withColumn("passage", passage).withColumn("text", select(F.col("passage")))


def cited_answer(prose: Column, cited: Column, retrieved: Column, printed: Column | None = None) -> Column:
    """(text, citations, inert, disclaimer) of what a model wrote: without citation marks (but ``printed`` acronyms) and its own copy of the
    disclaimer; the retrieved (id, url, title) that it cites, in their order, and nothing else; what reads like a link, a
    number to call or a handle, which stays plain."""
    text = F.trim(F.regexp_replace(without_citations(prose, printed), COPY, ""))
    known = F.filter(retrieved, lambda c: F.array_contains(cited, c["id"]))
    return F.struct(text.alias("text"), known.alias("citations"), inert(text).alias("inert"), F.lit(DISCLAIMER).alias("disclaimer"))


# ---- measures over labelled questions --------------------------------------------------------------------------------


def answer_rows(questions: DataFrame, accepted: DataFrame, cards: DataFrame, lead_words: int = LEAD_WORDS, select: Select = openings) -> DataFrame:
    """A row for each scoreable query (one of ``questions`` (query, source, snippet) that has both): whether the short answer, the passage, the
    lead card, heads of as many words and any card hold an accepted answer, and the answer's length (null without an answer). Accepted
    are the question's own snippet and those of ``accepted`` (query, source, snippet), each in texts of its own source alone."""
    own = questions.where("coalesce(source, '') <> '' AND coalesce(snippet, '') <> ''").select("query", "source", "snippet")
    more = accepted.join(own.select("query").distinct(), "query", "left_semi").select("query", "source", "snippet")
    needles = own.unionByName(more).withColumn("needle", folded_words(F.col("snippet"))).where("needle <> '' AND coalesce(source, '') <> ''")
    listed = own.select("query").distinct().join(needles.groupBy("query").agg(F.collect_set(F.struct("source", "needle")).alias("needles")), "query", "left")
    empty = F.array().cast("array<struct<source: string, needle: string>>")
    listed = listed.withColumn("needles", F.coalesce("needles", empty))

    def holds(text: Column, source: Column) -> Column:
        hay = folded_words(text)
        return F.exists("needles", lambda n: (n["source"] == source) & F.contains(hay, n["needle"]))

    passage = heading_stripped(F.col("excerpt"), F.coalesce("section", F.lit("")))
    each = cards.select("query", "rank", "source", "section", "excerpt").join(listed, "query")
    # a selector may be Python: it stands in a projection of its own, its text is read once
    each = each.withColumn("passage", passage).withColumn("text", select(F.col("passage")))
    has = holds(F.col("excerpt"), F.col("source"))
    each = each.select("*", has.alias("held"), (has & holds(F.col("text"), F.col("source"))).alias("reached"), n_words(F.col("text")).alias("budget"))
    lead = F.col("rank") == 1
    first = {
        "answered": holds(F.col("text"), F.col("source")),
        "expanded": holds(F.col("passage"), F.col("source")),
        "baseline": holds(first_words(F.col("excerpt"), lead_words), F.col("source")),
        "head_same": holds(first_words(F.col("passage"), F.col("budget")), F.col("source")),
        "head_lead": holds(first_words(F.col("excerpt"), F.col("budget")), F.col("source")),
    }
    flags = each.select("query", "rank", "held", "reached", F.when(lead, F.col("budget")).alias("length"), *[F.coalesce(F.when(lead, c), F.lit(False)).alias(n) for n, c in first.items()])
    per = flags.groupBy("query").agg(
        F.max("length").alias("length"), *[F.max(n).alias(n) for n in first], F.max("held").alias("in_top"), F.max("reached").alias("best_card"), F.min(F.when(F.col("held"), F.col("rank"))).alias("_at")
    )
    rows = listed.select("query").join(per, "query", "left")
    names = (*first, "in_top", "best_card")
    rows = rows.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})
    return rows.withColumn("buried", F.coalesce((F.col("_at") > 1) & ~F.col("answered"), F.lit(False))).drop("_at")


PAIRS = {"experience_card": ("expanded", "baseline"), "tier1_head": ("answered", "head_lead"), "tier1_card": ("answered", "baseline")}
COUNTS = ("answered", "expanded", "baseline", "in_top", "buried", "best_card", "head_same", "head_lead")


def answer_measures(rows: DataFrame, lead_words: int = LEAD_WORDS) -> DataFrame:
    """One row over answer_rows: n, counts, for each pair of surfaces how many queries the one alone has and the other alone and the exact
    chance of that, how many answers were given, their median, 90th percentile and greatest length (at floor(n f) of the sorted
    ones; 0 without any), and how many are longer than the lead card."""
    pairs = [F.count_if(F.col(x) & ~F.col(y)).alias(f"{p}_{s}") for p, (a, b) in PAIRS.items() for s, x, y in (("gained", a, b), ("lost", b, a))]
    total = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in COUNTS], *pairs, F.count("length").alias("rendered"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"), F.count_if(F.col("length") > lead_words).alias("over_card"))
    n = rows.where("length IS NOT NULL").count()
    places = at_places(rows.where("length IS NOT NULL"), "length", [int(n * 0.5), int(n * 0.9)], n) if n else [0, 0]
    chances = {f"{p}_p": sign_test(F.col(f"{p}_gained"), F.col(f"{p}_lost")) for p in PAIRS}
    return total.withColumns({"median": F.lit(int(places[0])), "p90": F.lit(int(places[1])), **chances})


def gate_failures(measures: DataFrame, floors: Mapping[str, float], dirty: int = 0, lead_words: int = LEAD_WORDS, bars: Mapping[str, bool] = {"tier1_head": False}, alpha: float = ALPHA) -> DataFrame:  # noqa: B006
    """(nth, failure) of what keeps a run from passing, in order: bars (whether they ask for significance) not won, shares of n under
    their ``floors``, answers longer than the lead card, junk. A run that passes has no row; without questions floors say nothing."""
    found = []
    for bar, significant in bars.items():
        gained, lost = F.col(f"{bar}_gained"), F.col(f"{bar}_lost")
        found.append(F.when(~bar_passed(gained, lost, False), F.lit(f"{bar}: direction")).when(~bar_passed(gained, lost, significant, alpha), F.lit(f"{bar}: significance")))
    for name, floor in floors.items():
        share = F.when(F.col("n") > 0, F.col(name) / F.col("n"))
        found.append(F.when(share < floor, F.format_string(f"{name}: %.1f%% is below the floor of {floor * 100:.1f}%%", share * 100)))
    found.append(F.when(F.col("over_card") > 0, F.format_string(f"%d answers are longer than the {lead_words}-word card", F.col("over_card"))))
    found.append(F.when(F.lit(dirty) > 0, F.lit(f"{dirty} passages carry junk in the selected answer")))
    return measures.select(F.posexplode(F.array(*found)).alias("nth", "failure")).where("failure IS NOT NULL")


def junk(passages: DataFrame, select: Select = openings) -> DataFrame:
    """(id, label, sample) of the passages (id, section, text) whose selected answer carries junk or breaks a rule, one row for each."""
    body = heading_stripped(shown_text(F.col("text")), F.coalesce("section", F.lit("")))
    rows = passages.withColumn("_answer", select(body))
    labels = F.array_compact(F.concat(F.array(*[F.when(F.col("_answer").rlike(p), F.lit(label)) for label, p in JUNK.items()]), F.transform(violated(F.col("_answer"), F.col("section")), lambda x: F.concat(F.lit("property "), x))))
    return rows.select("id", F.explode(labels).alias("label"), F.left("_answer", F.lit(90)).alias("sample"))


def selection_given_passage(questions: DataFrame, passages: DataFrame, select: Select = openings, probe: int = PROBE) -> DataFrame:
    """(query, id, hit) for the questions (query, source, snippet) of which a passage (id, ord, source, section, text) of the source, folded, holds the
    first ``probe`` letters of the folded snippet: the first such passage, and whether the answer selected from it holds the snippet."""
    asked = questions.where("coalesce(source, '') <> '' AND coalesce(snippet, '') <> ''").select(F.col("query").alias("key"), "source", folded_words(F.col("snippet")).alias("needle"))
    folded = passages.select("id", "source", folded_words(F.col("text")).alias("text"))
    pairs = containing(folded, asked.select("key", "source", F.left("needle", F.lit(probe)).alias("snippet")))
    first = pairs.join(passages.select("id", "ord"), "id").groupBy("key").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))
    body = heading_stripped(shown_text(F.col("text")), F.coalesce("section", F.lit("")))
    found = first.join(passages.select("id", "section", "text"), "id").join(asked.select("key", "needle"), "key").withColumn("_answer", select(body))
    return found.select(F.col("key").alias("query"), "id", F.contains(folded_words(F.col("_answer")), "needle").alias("hit"))


def ranked_cards(results: DataFrame, query: str = "query", score: str = "score", tie: str = "id") -> DataFrame:
    """Results with rank in the order of score, then ``tie``, from 1 on."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie)))
