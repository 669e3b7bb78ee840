"""Cleaning of extracted blocks: what kind each is, headers and footers that a document repeats, what goes and what stays.

Kinds and scores are expressions. A running header is what most blocks of a document share at their ends, which reads them
together; that runs as Arrow batches of whole documents. Numbers and patterns that decide are fixed values.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import CHROME, QUESTION_BANK, pattern
from ..functions.text import SPACES, canonical, snippet, trimmed
from .chunking import MARKERS
from .common import small_batches

# ---- kinds of blocks. Fixed values -----------------------------------------------------------------------------------

CONTENTS = r"(?i)table of contents|^contents"
SHARE, LEADERS, LONE_LEADERS, LONE_BASE, LONE_RATIO = 0.12, 3, 9, 0.7, 0.5
ENDORSEMENT = r"(?i)does not constitute a formal endorsement"
ACTIVITY = r"^\s*ACTIVITY\s+[\d.]+\s*:\s*[^\n]{0,40}QUIZ"
EARLY_PAGE, LONGEST_COVER, DENSEST_COVER = 3, 300, 0.3
VERSION = r"(?i)version\s+\d"
MONTH_YEAR = r"(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+(?:19|20)\d{2}\b"
TERMINATOR = r"[a-zA-Z]{2,}[.!?](?=\s|$)"
FIRES, DROPS = 0.5, 0.7


def _count(text: Column, p: str) -> Column:
    return F.regexp_count(text, F.lit(pattern(p)))


def contents_score(text: Column) -> Column:
    """How much a block reads as a table of contents: by page numbers and dotted leaders among its words, by leaders alone where it
    doesn't say that it is one."""
    leaders = _count(text, r"\.{3,}")
    tokens = F.filter(F.split(text, f"[{SPACES}]+"), lambda t: t != "")
    refs = F.size(F.filter(tokens, lambda t: t.rlike("^[0-9]{1,3}$"))) + _count(text, r"\b[A-Z]-\d{1,3}\b")
    share = F.when(F.size(tokens) > 0, refs / F.size(tokens)).otherwise(0.0)
    lone = F.when((leaders < LONE_LEADERS) | (refs < leaders * LONE_RATIO), 0.0).otherwise(LONE_BASE + (1 - LONE_BASE) * F.least(F.lit(1.0), leaders / (2 * LONE_LEADERS)))
    named = F.when((share < SHARE) & (leaders < LEADERS), 0.0).otherwise(0.5 + 0.5 * F.greatest(F.least(F.lit(1.0), share / (2 * SHARE)), F.least(F.lit(1.0), leaders / (2 * LEADERS))))
    return F.when(text.rlike(pattern(CONTENTS)), named).otherwise(lone)


def cover_score(text: Column, page: Column) -> Column:
    """How much a block reads as the stamp of a cover: early, short, with a version and a month, and hardly a sentence."""
    density = _count(text, TERMINATOR) / F.length(text) * 100
    early = F.coalesce(page <= EARLY_PAGE, F.lit(False)) & (F.length(text) <= LONGEST_COVER)
    fits = early & text.rlike(pattern(VERSION)) & text.rlike(pattern(MONTH_YEAR)) & (density <= DENSEST_COVER)
    return F.when(F.coalesce(fits, F.lit(False)), 0.5 + 0.5 * (1 - density / DENSEST_COVER)).otherwise(0.0)


def classified(blocks: DataFrame, text: str = "text", page: str = "page") -> DataFrame:
    """Adds kind (content, chrome, exercise, toc, disclaimer or frontmatter, of equal scores the first of these) and confidence."""
    t = F.col(text)
    out = blocks.withColumns(
        {
            "_exercise": F.when(t.rlike("(?i)" + pattern(QUESTION_BANK)) | t.rlike("(?i)" + pattern(ACTIVITY)), 1.0).otherwise(0.0),
            "_toc": contents_score(t),
            "_disclaimer": F.when(t.rlike(ENDORSEMENT), 1.0).otherwise(0.0),
            "_front": cover_score(t, F.col(page)),
        }
    )
    scores = {"exercise": F.col("_exercise"), "toc": F.col("_toc"), "disclaimer": F.col("_disclaimer"), "frontmatter": F.col("_front")}
    best = F.greatest(*scores.values())
    kind = F.when(F.lower(trimmed(t)).isin(*CHROME), "chrome").when(best < FIRES, "content")
    for name, score in scores.items():
        kind = kind.when(score == best, name)
    out = out.withColumn("kind", kind)
    return out.withColumn("confidence", F.when(F.col("kind") == "chrome", 1.0).when(F.col("kind") == "content", 1 - best).otherwise(best)).drop("_exercise", "_toc", "_disclaimer", "_front")


# ---- running headers and footers. Fixed values -----------------------------------------------------------------------

FEWEST_BLOCKS, SHORTEST_BLOCK, MAJORITY, SHORTEST_SEGMENT, MOST_SEGMENTS, PAGE_DIGITS = 12, 20, 0.5, 5, 4, 3
_RUN = re.compile(f"[{SPACES}]?[0-9]*[{SPACES}]?")


def _page_run(text: str, at: int) -> int:
    """Where a page number between two spaces, all of them optional, ends; ``at`` if its digits are too many."""
    m = _RUN.match(text, at)
    return m.end() if sum(c.isdigit() for c in m[0]) <= PAGE_DIGITS else at


def segments(texts: list[str], total: int) -> list[str]:
    """What most texts start with, piece by piece with page numbers between. A piece is the common prefix of the texts that share
    the most frequent first letter, if they are a majority; the least and the greatest of them tell it."""
    out = []
    rest = [t[_page_run(t, 0) :] for t in texts]
    while len(out) < MOST_SEGMENTS:
        first = Counter(t[0] for t in rest if t)
        letter, n = first.most_common(1)[0] if first else ("", 0)
        if not n or n < MAJORITY * total:
            break
        rest = [t for t in rest if t[:1] == letter]
        piece = commonprefix([min(rest), max(rest)])
        whole = piece.strip()
        if len(whole) < SHORTEST_SEGMENT or not re.search("[A-Za-z]", whole):
            break
        out.append(whole)
        rest = [t[_page_run(t, len(piece)) :] for t in rest]
    return out


def running_affix(texts: list[str]) -> tuple[list[str], list[str]]:
    """(prefix, suffix): the pieces that most longer blocks of a document start and end with, in reading order."""
    long = [t for t in texts if len(t) >= SHORTEST_BLOCK]
    if len(long) < FEWEST_BLOCKS:
        return [], []
    back = segments([t[::-1] for t in long], len(long))
    return segments(long, len(long)), [s[::-1] for s in reversed(back)]


def _without(text: str, pieces: list[str]) -> str:
    """The text without the pieces at its front, up to the first that isn't there, and the page numbers around them."""
    at = 0
    for k, piece in enumerate(pieces):
        if k == 0 and not text.startswith(piece) and text.startswith(piece, _page_run(text, 0)):
            at = _page_run(text, 0)
        if not text.startswith(piece, at):
            break
        at = _page_run(text, at + len(piece))
    return text[at:]


#: Runs of module names that a page's index leaves. Fixed values.
_MODULE, _INDEX = r"(?:Module \d+(?: Acronyms)?|Appendix [A-Z])", r"(?:MODULE \d+|APPENDIX [A-Z]|CHECKLIST)"
_CATALOG = re.compile(f" ?{_MODULE}{_MODULE}{{2,}} ?")
_LISTING = re.compile(f" ?{_INDEX}(?: ?{_INDEX}){{2,}} ?")
_LEADER, _NUMBER = re.compile(f"\\.{{3,}}[{SPACES}]*[0-9]*[{SPACES}]*$"), re.compile(f"[{SPACES}]*[0-9]+[{SPACES}]*")


def without_running(text: str, prefix: list[str], suffix: list[str]) -> str:
    """A block without running pieces, indexes of modules, a trailing dotted leader; nothing if a page number is all that is left."""
    out = _without(text, prefix)
    out = _without(out[::-1], [s[::-1] for s in reversed(suffix)])[::-1]
    out = _LEADER.sub("", _LISTING.sub(" ", _CATALOG.sub(" ", out)))
    return "" if _NUMBER.fullmatch(out) else out.strip()


def affixes(blocks: DataFrame, finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds stripped, prefix and suffix: each block without its document's running pieces and other furniture, and those pieces, from
    (id, ord, text, ...). Blocks are shuffled once, with all they carry, and leave as they came. ``finish`` is what more happens to a stripped
    block; it is worked out before blocks are rows, so that no condition on it repeats it."""
    columns = [c for c in blocks.columns if c != "id"]
    block = F.struct(F.col("ord").cast("long").alias("ord"), *[F.col(c) for c in columns if c != "ord"])
    listed = blocks.groupBy("id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    kinds = dict(listed.dtypes)
    small_batches(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("b")
            texts, many = held.flatten().field("text").to_pylist(), pa.compute.list_value_length(held).to_pylist()
            at, stripped, pieces = 0, [], []
            for n in many:
                own = [t or "" for t in texts[at : at + n]]
                at += n
                pieces.append(running_affix(own))
                stripped.append([without_running(t, *pieces[-1]) for t in own])
            out = [pa.array(x, pa.list_(pa.string())) for x in (stripped, [p for p, _ in pieces], [s for _, s in pieces])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), held, *out], names=["id", "b", "stripped", "prefix", "suffix"])

    found = listed.mapInArrow(run, f"id {kinds['id']}, b {kinds['b']}, stripped array<string>, prefix array<string>, suffix array<string>")
    if finish is not None:
        found = found.withColumn("stripped", F.transform("stripped", finish))
    each = found.select("id", F.explode(F.arrays_zip("b", "stripped")).alias("x"), "prefix", "suffix")
    return each.select("id", *[F.col("x.b").getField(c).alias(c) for c in columns], "x.stripped", "prefix", "suffix")


def without_exercise(text: Column) -> Column:
    """A block up to the heading of a true or false quiz at its end; the heading reaches back to the end of a sentence or the sign of
    a list."""
    # a run starts behind a boundary, so no other place is tried
    heading = rf"(?:^|(?<=[.!?{MARKERS}]))[^.!?{MARKERS}]*?\bQUIZ\s+TRUE\s+FALSE\b"
    return trimmed(F.when(text.rlike("(?i)QUIZ"), F.regexp_replace(text, "(?i)" + pattern(heading) + "(?s:.)*$", "")).otherwise(text))


def cleaned(blocks: DataFrame) -> DataFrame:
    """(id, ord, page, kind, confidence, action, text, before, after) from (id, ord, text, page): action is dropped (a sure kind, or
    nothing left: kind is then empty), review, stripped or kept; text is what stays; before and after are snippets of an edit."""
    rows = affixes(classified(blocks), without_exercise).withColumnRenamed("stripped", "after_")
    gone = (F.col("kind") != "content") & (F.col("confidence") >= DROPS)
    void = F.col("after_") == ""
    action = F.when(gone | void, "dropped").when(F.col("kind") != "content", "review").when(F.col("after_") != F.col("text"), "stripped").otherwise("kept")
    edited = ~gone & ~void & (F.col("after_") != F.col("text"))
    return rows.select(
        "id", "ord", "page",
        F.when(gone, F.col("kind")).when(void, "empty").otherwise(F.col("kind")).alias("kind"),
        "confidence", action.alias("action"), F.when(~gone & ~void, F.col("after_")).alias("text"),
        F.when(edited | gone | void, snippet(F.col("text"))).alias("before"), F.when(edited, snippet(F.col("after_"))).alias("after"),
    )


def rebuilt(rows: DataFrame) -> DataFrame:
    """(id, text): the canonical text of what cleaned keeps, in order."""
    listed = rows.where("text IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return listed.select("id", canonical(F.array_join("b.text", "\n")).alias("text"))
