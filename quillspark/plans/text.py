"""Queries over texts: canonical forms, ids, similarity, grounding, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import rules as R
from ..operators.common import spread, table

_SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_NUMBERED = "t0"
for _k, (_w, _d) in enumerate(T.NUMBER_WORDS.items()):
    _NUMBERED = f"regexp_replace({_NUMBERED}, '(?i)\\b{_w}\\b', '{_d}', 'g')"


def _canonical_sql(column: str) -> str:
    out = f"nfc_normalize({column})"
    for a, b in T.LIGATURES.items():
        out = f"replace({out}, chr({ord(a)}), '{b}')"
    for c in T.INVISIBLE:
        out = f"replace({out}, chr({ord(c)}), '')"
    return f"trim(regexp_replace(regexp_replace({out}, '-[ \\t]*\\r?\\n[ \\t]*', '', 'g'), '{_SPACE}', ' ', 'g'))"


def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forms of all documents by digest, and passage ids made of them."""
    d = table(spark, sf_dir, "documents")
    c = d.select("doc_id", "source", T.canonical(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("size"), F.sha2("c", 256).alias("digest"), F.concat("source", F.lit(":"), F.substring(F.sha2("c", 256), 1, 12)).alias("chunk_id"))


def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, of different tokens and the plain form's digest of each document."""
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", T.tokens(F.col("text")).alias("w"), F.sha2(T.plain(F.col("text")), 256).alias("plain_digest"))
    return t.select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), "plain_digest")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.split_bucket(F.col("text")).cast("long").alias("bucket"))


def extraction_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each document's text, taken as an extraction of a page for each 2,000 characters begun."""
    d = spread(table(spark, sf_dir, "documents")).withColumn("pages", F.ceil(F.col("n_chars") / 2000))
    return d.select("doc_id", F.array_join(T.extraction_faults(F.col("text"), F.col("pages")), ",").alias("faults"))


def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram similarity of each document with the one of the next id."""
    w = table(spark, sf_dir, "documents").select("doc_id", T.words(F.lower("text")).alias("w"))
    d = w.select("doc_id", T.trigrams(F.col("w")).alias("g"))
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return d.join(after, "doc_id").select("doc_id", F.round(T.trigram_similarity(F.col("g"), F.col("h")), 9).alias("similarity"))


def numeric_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each assistant turn that the turn before doesn't have."""
    c = table(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("cited"))
    pairs = c.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    answer = F.concat(F.lit("About twenty of 3 and "), F.col("turn").cast("string"), F.lit(" or 1,000: "), F.col("text"))
    return pairs.select("conv_id", "turn", F.array_join(T.ungrounded(answer, F.concat(F.lit("three or twenty; "), "cited")), "|").alias("ungrounded"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that made-up answers cite, those not retrieved, and the answers without the marks."""
    d = table(spark, sf_dir, "documents")
    answer = F.concat(F.col("text"), F.lit(" [src:"), (F.col("doc_id") % 7).cast("string"), F.lit("] and [VA] as [src:"), (F.col("doc_id") % 3).cast("string"), F.lit("] says . [src:0]"))
    t = d.select("doc_id", answer.alias("answer"), F.array(F.lit("VA")).alias("printed"), F.array(F.lit("src:0"), F.lit("src:1"), F.lit("src:2")).alias("retrieved"))
    ids = T.cited_ids(F.col("answer"), F.col("printed"))
    return t.select("doc_id", F.array_join(ids, ",").alias("cited"), F.array_join(F.array_except(ids, "retrieved"), ",").alias("invalid"), F.sha2(T.without_citations(F.col("answer"), F.col("printed")), 256).alias("prose"), F.array_join(T.acronyms(F.col("answer")), ",").alias("acronyms"))


def calendar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.calendar_escaped(F.col("text")), 256).alias("digest"))


def heading_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their heading, which is here their first one to three words, for every fifth in the wrong case."""
    d = table(spark, sf_dir, "documents")
    section = F.when(F.col("doc_id") % 3 == 0, F.substring_index("text", " ", 1)).when(F.col("doc_id") % 3 == 1, F.substring_index("text", " ", 2)).otherwise(F.substring_index("text", " ", 3))
    section = F.when(F.col("doc_id") % 5 == 0, F.lower(section)).otherwise(section)
    return d.withColumn("section", section).select("doc_id", F.sha2(T.heading_stripped(F.col("text"), F.col("section")), 256).alias("body"))


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's host is a government's, and which resources of its HTML lie off its origin."""
    p = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "^([a-z]+://[^/?#]+)", "$1.gov")).otherwise(F.col("url"))
    off = U.off_origin_urls(F.col("html"), U.origin(F.col("url")))
    return p.select("page_id", U.government_url(url).alias("government"), F.array_join(off, " ").alias("off_origin"))


PATTERNS = (("email", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[a-z]+"), ("number", "[0-9]{13,}"), ("phone", "\\+[0-9]"))


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, token) of every line that shows an address or a long number."""
    return R.pattern_hits(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), PATTERNS)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document's first and last letters and a short part stand in it."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.occurrences(F.col("text"), F.lit("en")).alias("en"), T.occurrences(F.col("text"), F.right("text", F.lit(1))).alias("last"))


QUERIES = {f"text_{f.__name__}": f for f in (canonical_text, token_statistics, snippets, extraction_sanity, neighbour_similarity, numeric_grounding, citations, calendar_text, heading_echo, url_checks, pattern_hits, occurrences)}

ORACLES = {
    "text_canonical_text": f"SELECT doc_id, length(c)::BIGINT AS size, sha256(c) AS digest, source || ':' || left(sha256(c), 12) AS chunk_id FROM (SELECT doc_id, source, {_canonical_sql('text')} AS c FROM documents)",
    "text_token_statistics": "SELECT doc_id, len(w)::BIGINT AS n, len(list_distinct(w))::BIGINT AS n_distinct, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS plain_digest FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)",
    "text_snippets": "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 60) || ' [...] ' || right(text, 60) END AS snippet, (list_reduce(list_prepend(5381::BIGINT, flatten(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + ((unicode(c) - 65536) >> 10)::BIGINT, 56320 + ((unicode(c) - 65536) & 1023)::BIGINT] END))), lambda h, c: (h * 33 + c) % 4294967296) % 100)::BIGINT AS bucket FROM documents",
    "text_extraction_sanity": f"WITH t AS (SELECT doc_id, ceil(n_chars / 2000) AS pages, regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g') AS t FROM documents), u AS (SELECT *, length(t) + length(regexp_replace(t, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) AS n FROM t) SELECT doc_id, CASE WHEN n = 0 THEN 'empty' ELSE concat_ws(',', CASE WHEN pages > 0 AND n < pages * 100 THEN 'sparse' END, CASE WHEN length(t) - length(regexp_replace(t, '[\\x{{fffd}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) > n * 0.02 THEN 'garbled' END) END AS faults FROM u",
    "text_neighbour_similarity": f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{_SPACE.replace('[', '[^', 1)}') AS w FROM documents), g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM w) SELECT a.doc_id, round(CASE WHEN len(a.g) + len(b.g) = 0 THEN 1.0 ELSE len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)) END, 9) AS similarity FROM g a JOIN g b ON b.doc_id = a.doc_id + 1",
    "text_numeric_grounding": f"WITH p AS (SELECT a.conv_id, a.turn, 'About twenty of 3 and ' || a.turn || ' or 1,000: ' || a.text AS answer, 'three or twenty; ' || b.text AS cited FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant'), n AS (SELECT conv_id, turn, regexp_extract_all({_NUMBERED.replace('t0', 'answer')}, '{T.NUMBER}') AS x, regexp_extract_all({_NUMBERED.replace('t0', 'cited')}, '{T.NUMBER}') AS y FROM p) SELECT conv_id, turn, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), '|') AS ungrounded FROM n",
    "text_citations": f"WITH t AS (SELECT doc_id, text || ' [src:' || (doc_id % 7) || '] and [VA] as [src:' || (doc_id % 3) || '] says . [src:0]' AS a FROM documents), b AS (SELECT doc_id, a, regexp_extract_all(a, '\\[([A-Za-z0-9_.:-]+)\\]', 1) AS l FROM t), u AS (SELECT doc_id, a, list_filter(l, lambda x, i: list_position(l, x) = i) AS ids FROM b) SELECT doc_id, array_to_string(list_filter(ids, lambda x: x <> 'VA'), ',') AS cited, array_to_string(list_filter(ids, lambda x: x NOT IN ('VA', 'src:0', 'src:1', 'src:2')), ',') AS invalid, sha256(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(replace(a, '[VA]', chr(57344)), '\\[([A-Za-z0-9_.:-]+)\\]', '', 'g'), chr(57344), '[VA]'), '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]+([.,;:!?])', '\\1', 'g'), '^{_SPACE}|{_SPACE}$', '', 'g')) AS prose, array_to_string(list_filter(ids, lambda x: regexp_full_match(x, '[A-Z]+')), ',') AS acronyms FROM u",
    "text_calendar_text": "SELECT doc_id, sha256(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(13) || chr(10), '\\n'), chr(13), '\\n'), chr(10), '\\n')) AS digest FROM documents",
    "text_heading_echo": f"WITH o AS (SELECT doc_id, text, array_to_string(string_split(text, ' ')[1:doc_id % 3 + 1], ' ') AS x FROM documents), p AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN lower(x) ELSE x END AS section FROM o) SELECT doc_id, sha256(CASE WHEN length(section) > 0 AND starts_with(text, section) AND NOT regexp_matches(substr(text, length(section) + 1), '^[A-Za-z0-9]') AND NOT regexp_matches(section, '^(?i:if|unless)\\b') THEN regexp_replace(substr(text, length(section) + 1), '^{_SPACE.replace(']+', ':.-]+')}', '') ELSE text END) AS body FROM p",
    "text_url_checks": f"WITH h AS (SELECT page_id, html, url, lower(regexp_extract(CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^([a-z]+://[^/?#]+)', '\\1.gov') ELSE url END, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages) SELECT page_id, regexp_matches(host, '(^|\\.)(gov|mil)$') AS government, array_to_string(list_filter(regexp_extract_all(html, '(?i)\\bsrc\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda u: regexp_matches(u, '^(?i:https?)://') AND regexp_extract(u, '^([A-Za-z]+://[^/?#]+)', 1) <> regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)), ' ') AS off_origin FROM h",
    "text_pattern_hits": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, line::BIGINT AS line, token FROM l, (VALUES ('email', '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[a-z]+'), ('number', '[0-9]{13,}'), ('phone', '\\+[0-9]')) r(token, pattern) WHERE regexp_matches(content, pattern)",
    "text_occurrences": "SELECT doc_id, ((length(text) - length(replace(text, 'en', ''))) // 2)::BIGINT AS en, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, right(text, 1), '')) END::BIGINT AS last FROM documents",
}
