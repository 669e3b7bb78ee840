"""Queries over texts in pieces: sentences, passages, cleaned blocks, places that name a passage, what is shown of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import cleaning as L
from ..operators import registry as G
from ..operators.common import spread, staged, table


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ord, text, page): canonical lines of documents as blocks, five of them a page."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.posexplode(T.canonical_lines(F.col("text"))).alias("ord", "text"))
    return d.select("id", "ord", F.trim("text").alias("text"), (F.col("ord") / 5 + 1).cast("int").alias("page")).where("text <> ''")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of sentences of each document with abbreviations in it, and the digest of their lengths."""
    text = F.concat(F.lit("See No. 5 or fig. 2 by Dr. Ito vs. 7. The U.S. Army (e.g. \"Corps.\") Xi! "), F.col("text"))
    s = table(spark, sf_dir, "documents").select("doc_id", C.sentences(text).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join(F.transform("s", lambda x: F.length(x).cast("string")), ","), 256).alias("lengths"))


def list_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", "[,.] ", " • ")
    s = table(spark, sf_dir, "documents").select("doc_id", C.list_pieces(text).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, blocks) for the chunker: a line that is short is the section of what follows. A line that ends with a hyphen is joined to
    the next without it, in its block too, so that all blocks stand in the text. Documents stay rows: their numbered lines are cut before
    each section, and the lines of a piece take the first of them along."""
    # whether a text has blocks is told by the text: a condition on blocks would make them before documents are dealt out, once more
    read = table(spark, sf_dir, "documents").where(F.col("text").rlike(f"[^{T.SPACES}{T.INVISIBLE}]"))
    lines = spread(read).select(F.col("doc_id").alias("id"), F.transform(T.canonical_lines(F.col("text")), lambda x: F.trim(x)).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.concat(F.when(F.length(x) < 40, C.CUT).otherwise(""), i.cast("string"), F.lit(" "), x))
    pieces = F.split(F.array_join(F.filter(numbered, lambda x: ~x.endswith(" ")), "\n"), f"\n?{C.CUT}")
    text = lambda x: F.substring(x, F.instr(x, " ") + 1, F.length(x))
    parted = F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.struct(F.split(x, "\n").alias("lines"), text(F.substring_index(x, "\n", 1)).alias("head")))
    headed = F.transform(parted, lambda p: p.withField("head", F.when(F.length(p["head"]) < 40, p["head"])))
    line = lambda x, p: F.struct(F.substring_index(x, " ", 1).cast("int").alias("ord"), text(x).alias("text"), p["head"].alias("section"))
    whole = lines.select("id", headed.alias("parts")).select("id", F.flatten(F.transform("parts", lambda p: F.transform(p["lines"], lambda x: line(x, p)))).alias("blocks"))
    joined = F.replace(F.replace(F.array_join("blocks.text", "\n"), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    cut = lambda b, i: F.when((i < F.size("blocks") - 1) & b["text"].endswith("-"), F.left(b["text"], F.length(b["text"]) - 1)).otherwise(b["text"])
    kept = F.transform("blocks", lambda b, i: F.struct(b["ord"].alias("ord"), cut(b, i).alias("text"), b["section"].alias("section"), (b["ord"] / 5 + 1).cast("int").alias("page")))
    return whole.select("id", F.filter(kept, lambda b: b["text"] != "").alias("blocks"), joined.alias("text"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 256 words at most of all documents, with their sections and places."""
    out = C.passages(_documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "nth", "start", "end", "section", "page", "broken")


def passage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the passages of each text cover it: how many there are, and the first fault; a text that can't be cut has uncut."""
    docs = staged(_documents(spark, sf_dir), "coverage-documents")
    spans = staged(C.passages(docs), "coverage-spans")
    counts = spans.groupBy("id").agg(F.sum((F.col("nth") >= 0).cast("long")).alias("n"), F.max(F.col("nth") < 0).alias("uncut"))
    faults = G.span_faults(spans.where("nth >= 0").select("id", "start", "end"), docs.select("id", "text"), "id")
    rows = docs.select("id").join(counts, "id", "left").join(faults, "id", "left")
    fault = F.when(F.col("uncut"), "uncut").otherwise(F.col("fault"))
    return rows.select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("passages"), fault.alias("fault"), F.when(~F.coalesce("uncut", F.lit(False)), F.col("at")).cast("long").alias("at"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that name each passage in its text, by the fewest characters beside it; here passages of 64 words."""
    docs = staged(_documents(spark, sf_dir), "anchors-documents")
    found = C.anchors(C.passages(docs, 64).where("nth >= 0").select("id", "start", "end"), docs.select("id", "text"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", "found", F.length("prefix").alias("prefix"), F.length("suffix").alias("suffix"))


#: Vowels in capitals with another accent each: without, acute; with any, none.
_VOWELS = "AEIOUÁÉÍÓÚÀÂÄÈÊËÎÏÔÖÙÛÜ", "ÁÉÍÓÚAEIOUAAAEEEIIOOUUU"


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where passages of 96 words are found again in their documents' pages: from the page that is said to have them (for a third the
    one after, if there is one), with every vowel's accent and case changed. Each passage has a row; one that isn't found has no page."""
    docs = staged(_documents(spark, sf_dir), "highlights-documents")
    step = lambda b, i: b["page"] - F.coalesce(F.get(F.col("blocks"), i - 1)["page"], F.lit(1))
    pages = F.array_join(F.transform("blocks", lambda b, i: F.concat(F.when(step(b, i) > 0, F.repeat(F.lit(C.CUT), step(b, i))).when(i > 0, " ").otherwise(""), b["text"])), "")
    held = docs.select("id", F.split(pages, C.CUT).alias("pages"))
    last = docs.select("id", F.element_at("blocks", -1)["page"].alias("last"))
    spans = C.passages(docs, 96, texts=True).join(last, "id")
    said = F.least(F.col("page") + (F.col("nth") % 3 == 2).cast("int"), "last")
    cited = spans.select(F.concat_ws(":", "id", "nth").alias("key"), "id", said.alias("page"), F.translate(F.upper("passage"), *_VOWELS).alias("passage"))
    return C.highlights(cited, held).select("key", "page", "start", "end", F.round("coverage", 6).alias("coverage"))


FURNITURE = (
    "Table of Contents Getting ready 3 Housing 12 Health 40 Work 51 A-16", "First steps .... 1 Second .... 2 Third .... 3 4 .... 5 .... 6 .... 7 .... 8 .... 9 .... 10 .... 11", "This guide does not constitute a formal endorsement of any firm.",
    "Guide to Moving Version 6.1 March 2024", "Module Question Module 1 a b", "ACTIVITY 2.1: Health QUIZ now", "Related Articles", "Real prose that mentions Version 2 in March 2024 and goes on for a while. It has sentences.", "A list of words. JOB QUIZ TRUE FALSE 1 2 3",
)


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which each ninth is furniture."""
    b = _blocks(spark, sf_dir)
    return b.withColumn("text", F.when((F.col("id") + F.col("ord")) % 9 == 0, F.get(F.array(*map(F.lit, FURNITURE)), ((F.col("id") + F.col("ord")) / 9 % 9).cast("int"))).otherwise(F.col("text")))


def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.classified(_mixed(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "kind", F.round("confidence", 6).alias("confidence"))


def cleaned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning does to each block of documents whose pages carry a running header and footer."""
    b = _mixed(spark, sf_dir)
    running = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Moving Guide "), F.col("page").cast("string"), F.lit(" "), "text", F.lit(" Revised 2024"))).otherwise(F.col("text"))
    out = L.cleaned(b.withColumn("text", running))
    return out.select(F.col("id").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "kind", "action", "text", "before", "after")


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rebuilt from what cleaning keeps."""
    return L.rebuilt(L.cleaned(_mixed(spark, sf_dir))).select(F.col("id").alias("doc_id"), F.length("text").alias("size"), F.sha2("text", 256).alias("digest"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made fit to show, and the opening sentences that answer."""
    head = F.concat(F.lit("page 1"), F.lit("Mental Health Version 6 1 Released March 2024, Revised July 2025 EFCT PARTICIPANT GUIDE | SECTION 1 | PAGE 14 • one •• two y three ______ "), F.col("text"))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", C.shown_text(head).alias("t"))
    return d.select("doc_id", F.sha2("t", 256).alias("digest"), C.openings(F.col("t")).alias("opening"))


QUERIES = {f"passages_{f.__name__}": f for f in (sentences, list_pieces, passages, passage_coverage, anchors, highlights, block_kinds, cleaned_blocks, cleaned_texts, shown)}

_S = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in C.ABBREVIATIONS)
_MARK, _CUT = "chr(57345)", "chr(57346)"
_BOUNDARY = f"'([^' || {_MARK} || '.!?])([.!?]+[\"'')\\]]*[{_S}]+)([A-Z0-9])', '\\1\\2' || {_CUT} || '\\3', 'g'"
_KINDS = f"""b AS (SELECT doc_id, o, x FROM blocks), m AS (SELECT doc_id, o, x, list_filter(string_split_regex(x, '[{_S}]+'), lambda t: t <> '') AS w, len(regexp_extract_all(x, '\\.{{3,}}')) AS leaders FROM b),
r AS (SELECT *, len(list_filter(w, lambda t: regexp_full_match(t, '[0-9]{{1,3}}'))) + len(regexp_extract_all(x, '\\b[A-Z]-[0-9]{{1,3}}\\b')) AS refs FROM m),
s AS (SELECT *, CASE WHEN regexp_matches(x, '(?i)table of contents|^contents') THEN CASE WHEN refs / len(w) < 0.12 AND leaders < 3 THEN 0 ELSE 0.5 + 0.5 * greatest(least(1, refs / len(w) / 0.24), least(1, leaders / 6)) END
  WHEN leaders < 9 OR refs < leaders * 0.5 THEN 0 ELSE 0.7 + 0.3 * least(1, leaders / 18) END AS toc,
  CASE WHEN regexp_matches(x, '(?i)Module Question[{_S}]+(?:Module[{_S}]+[0-9]|Number[{_S}]+Answer)') OR regexp_matches(x, '(?i)^[{_S}]*ACTIVITY[{_S}]+[0-9.]+[{_S}]*:[{_S}]*[^\\n]{{0,40}}QUIZ') THEN 1.0 ELSE 0 END AS ex, CASE WHEN regexp_matches(x, '(?i)does not constitute a formal endorsement') THEN 1.0 ELSE 0 END AS dis,
  len(regexp_extract_all(regexp_replace(x, '$', ' '), '[a-zA-Z]{{2,}}[.!?][{_S}]')) / length(x) * 100 AS density, o // 5 + 1 <= 3 AND length(x) <= 300 AND regexp_matches(x, '(?i)version[{_S}]+[0-9]') AND regexp_matches(x, '(?i)\\b(?:january|february|march|april|may|june|july|august|september|october|november|december)[{_S}]+(?:19|20)[0-9]{{2}}\\b') AS early FROM r),
f AS (SELECT *, CASE WHEN early AND density <= 0.3 THEN 0.5 + 0.5 * (1 - density / 0.3) ELSE 0 END AS front FROM s), k AS (SELECT *, greatest(ex, toc, dis, front) AS best FROM f)"""
from .text import _canonical_sql  # noqa: E402

_MIXED = f"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents), n AS (SELECT doc_id, o, {_canonical_sql('t')} AS t FROM l), blocks AS (SELECT doc_id, o, CASE WHEN (doc_id + o) % 9 = 0 THEN [" + ", ".join(f"'{x}'" for x in FURNITURE) + "][1 + (doc_id + o) // 9 % 9] ELSE t END AS x FROM n WHERE t <> '')"

ORACLES = {
    "passages_sentences": f"WITH t AS (SELECT doc_id, 'See No. 5 or fig. 2 by Dr. Ito vs. 7. The U.S. Army (e.g. \"Corps.\") Xi! ' || text AS t FROM documents), a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[{_S}])((?i:{_ABBREVIATED}))([.!?])', '\\1\\2' || {_MARK} || '\\3', 'g'), '(^|[{_S}])((?i:{_ABBREVIATED}))([.!?])', '\\1\\2' || {_MARK} || '\\3', 'g') AS t FROM t), c AS (SELECT doc_id, string_split(replace(regexp_replace(regexp_replace(t, {_BOUNDARY}), {_BOUNDARY}), {_MARK}, ''), {_CUT}) AS s FROM a) SELECT doc_id, len(s)::BIGINT AS n, sha256(array_to_string(list_transform(s, lambda x: length(x)::VARCHAR), ',')) AS lengths FROM c",
    "passages_list_pieces": f"WITH t AS (SELECT doc_id, regexp_replace(text, '[,.] ', ' • ', 'g') AS t FROM documents) SELECT doc_id, len(list_filter(string_split(regexp_replace(t, '([^•{_S}])([{_S}]*[{C.MARKERS}]+[{_S}]*)', '\\1' || {_CUT} || '\\2', 'g'), {_CUT}), lambda x: x <> ''))::BIGINT AS n, sha256(array_to_string(list_filter(string_split(regexp_replace(t, '([^•{_S}])([{_S}]*[{C.MARKERS}]+[{_S}]*)', '\\1' || {_CUT} || '\\2', 'g'), {_CUT}), lambda x: x <> ''), '|')) AS digest FROM t",
    "passages_block_kinds": f"WITH {_MIXED}, {_KINDS} SELECT doc_id, o AS ord, CASE WHEN lower(trim(x)) IN ('was this page helpful?', 'related articles', 'related information', 'related benefits & services', 'browse by topic') THEN 'chrome' WHEN best < 0.5 THEN 'content' WHEN best = ex THEN 'exercise' WHEN best = toc THEN 'toc' WHEN best = dis THEN 'disclaimer' ELSE 'frontmatter' END AS kind, round(CASE WHEN lower(trim(x)) IN ('was this page helpful?', 'related articles', 'related information', 'related benefits & services', 'browse by topic') THEN 1 WHEN best < 0.5 THEN 1 - best ELSE best END, 6)::DOUBLE AS confidence FROM k",
}
