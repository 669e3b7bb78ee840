"""Queries over a registry of sources and what hangs on it; its rows are made of documents, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import rules as R
from ..operators import sources as S
from ..operators.common import spread, staged, table


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry row for each supplier, with every kind of fault in some."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    text = lambda n, value: F.when(k % n != 0, F.lit(value) if isinstance(value, str) else value)
    day = F.when(k % 19 == 0, "2024-02-30").when(k % 23 == 0, "24-1-1").otherwise("2024-02-29")
    kind = F.when(k % 2 == 0, "pdf").when(k % 41 == 0, "doc").otherwise("html")
    return s.select(
        F.concat(F.lit("src_"), (k % 97).cast("string"), F.when(k % 31 == 0, "-X").otherwise("")).alias("source_id"), text(37, "title").alias("title"),
        F.when(k % 7 == 0, "http://va.gov/a").when(k % 11 == 0, "https://va.gov.example.com/a").when(k % 29 == 0, "https://user@www.VA.gov:443/a?x").otherwise("https://www.va.gov/a").alias("url"), F.lit("VA (x)").alias("origin"), text(43, "pd").alias("copyright_status"),
        F.when(k % 5 == 0, "excluded").when(k % 47 == 0, "odd").otherwise("confident_pd").alias("legal_tier"), kind.alias("content_type"), F.lit("n").alias("license_notes"), F.lit("open").alias("access"), text(53, "fetch").alias("scrape_method"),
        F.when(k % 59 == 0, "daily").otherwise("weekly").alias("update_check"), F.lit("1.0.0").alias("corpus_version_first_included"), day.alias("source_updated_date"), text(3, "me").alias("reviewed_by"), text(13, "2024-01-01").alias("reviewed_date"), text(17, "2023-12-31").alias("terms_reviewed_date"),
        (k % 4 == 0).alias("served"), F.when(k % 8 == 0, k % 16 == 0).alias("redistribution_cleared"), F.when(k % 6 == 0, F.when(k % 18 == 0, "https://x.example.com/d.pdf").otherwise("https://x.mil/d.pdf")).when(k % 9 == 0, "https://x.gov/e").alias("document_url"),
    )


def registry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.registry_faults(_registry(spark, sf_dir)).groupBy("source_id", "code", "field").agg(F.count("*").alias("n"))


def passage_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of passages that are made of documents: anchors of 12 characters of the text, some changed, some too short."""
    d = spread(table(spark, sf_dir, "documents"))
    k = F.col("doc_id")
    c = d.select("doc_id", T.canonical(F.col("text")).alias("text"), (k % 50).alias("s"))
    texts = c.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source"), "text").where("doc_id % 11 <> 0")
    anchor = F.when(k % 3 == 0, F.substr("text", F.lit(5), F.lit(40))).when(k % 3 == 1, F.substr("text", F.lit(3), F.lit(2))).when(k % 9 == 2, F.lit("not there @@"))
    passages = c.select(F.concat(F.when(k % 13 == 0, "BAD").otherwise("src"), F.lit(":"), F.left(F.sha2((k % 900).cast("string"), 256), F.lit(12)), F.when(k % 5 == 0, "-1").otherwise("")).alias("id"), F.concat(F.lit("d"), k.cast("string")).alias("source"), anchor.alias("anchor"))
    registry = d.where("doc_id % 7 <> 0").select(F.concat(F.lit("d"), k.cast("string")).alias("source"), F.when(k % 17 == 0, "excluded").otherwise("confident_pd").alias("legal_tier"))
    out = S.passage_faults(passages, registry, texts)
    return out.groupBy("source", "code").agg(F.count("*").alias("n"))


def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that suppliers list, in the order of the lists; unknown ones left out."""
    keys = table(spark, sf_dir, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("s_suppkey") * i * 7 % 300).alias("ids"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return S.listed(keys, items).select("s_suppkey", F.col("pos").cast("long").alias("pos"), "id", "p_name")


def after_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    links = keys.where("key % 3 <> 0").select("key", (F.col("key") % 40).alias("id"), F.concat(F.lit("go "), F.col("key").cast("string")).alias("label"))
    items = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://x/"), F.col("s_suppkey").cast("string")).alias("url"))
    return S.after_link(keys, links, items)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), "p_name", "p_size")
    info = p.where("source % 2 = 0").select("source", F.col("p_name").alias("title"))
    sizes = p.where("source % 3 = 0").select("source", F.col("p_size").cast("long").alias("bytes"))
    states = p.where("source % 5 <> 0").select("source", F.when(F.col("source") % 4 == 0, "saved").otherwise("unsaved").alias("state"))
    return S.library(p.select("source", F.concat(F.lit("/docs/"), F.col("source").cast("string")).alias("path")), info, sizes, states)


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return S.by_category(p, "p_brand", "p_partkey").select("p_brand", "p_partkey", F.col("nth").cast("long").alias("nth"), "first")


def lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order: what is extracted but not cleaned, named but not placed, recorded but not listed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return R.lacking(c, table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("key")), "key")


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source in which a snippet stands that comes from any place of every twentieth document of that source."""
    d = spread(table(spark, sf_dir, "documents"))
    place = (F.col("doc_id") * 7919 % F.greatest(F.length("text") - 30, F.lit(1)) + 1).cast("int")
    q = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "source", F.translate(F.substr("text", place, F.lit(30)), "'", "’").alias("snippet"))
    return S.expected_ids(q, d.select(F.col("doc_id").alias("id"), "source", "text"))


def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("doc"), F.col("l_linenumber").cast("long").alias("page"), "l_quantity")
    kept = e.where("l_quantity > 10").groupBy("doc", "page").agg(F.count("*").alias("n"))
    painted = e.where("l_quantity > 11 AND page < 7").groupBy("doc", "page").agg(F.count("*").alias("n"))
    return S.image_mismatches(kept, painted)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 2 == 0).alias("served"), F.when(F.col("p_partkey") % 5 != 0, "/docs/x").alias("served_path"))
    return S.manifest(p)


ORIGINS = ("VA (Benefits)", "DoW", "FRTIB (TSP)", "DOL", "DoD (x (y))")


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.cast("string").alias("source_id"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.when(k % 3 == 0, "https://lib.gov").otherwise(F.concat(F.lit("https://x.gov/"), k.cast("string"))).alias("url"), F.get(F.array(*map(F.lit, ORIGINS)), (k % 5).cast("int")).alias("origin"), F.when(k % 3 == 0, "pdf").otherwise("html").alias("content_type"), F.when(k % 3 == 0, F.concat(F.lit("https://d.gov/"), k.cast("string"))).alias("document_url"), F.concat(F.date_add(F.lit("2024-01-05").cast("date"), (k % 300).cast("int")).cast("string"), F.lit("T10:00:00Z")).alias("captured_at"), F.left(F.sha2(k.cast("string"), 256), F.lit(8)).alias("content_hash"), F.lit("captures/old").alias("captured_path"), F.lit("2023-01-01").alias("source_updated_date"))


def public_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    public, one = S.sources_index(_captured(spark, sf_dir))
    last = one.select(F.col("captured_from").alias("title"), F.col("library_url").alias("url"), F.col("captured_to").alias("publisher"), F.lit("all").alias("kind"))
    return public.unionByName(last)


def cited_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = S.document_urls(_captured(spark, sf_dir))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 120).cast("string").alias("source_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 6 - 1).alias("page"))
    return S.cited_urls(o, urls)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 40).alias("page"), F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, F.col("lang")).alias("anchor"))
    served = d.where("doc_id % 2 = 0").groupBy("source").agg(F.count("*").alias("n")).where("n % 2 = 0")
    return S.measured_population(d, served).select("doc_id", "source", "anchored")


def narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed results among JSON texts of which some lack what they need; then what a summary and a card get."""
    p = spread(table(spark, sf_dir, "part"))
    k = F.col("p_partkey")
    score = F.when(k % 7 == 0, F.lit('"high"')).otherwise(F.concat(F.lit("0."), (k % 9 + 1).cast("string")))
    url = F.when(k % 5 == 0, "https://va.gov.example.com").when(k % 11 == 0, "http://va.gov/x").otherwise("HTTPS://www.va.gov/x")
    raw = F.concat(F.lit('{"score": '), score, F.lit(', "chunk": {"id": "'), k.cast("string"), F.lit('", "text": "page 2 of • it", "sourceId": "s", "sourceTitle": '), F.when(k % 13 == 0, "5").otherwise('"T"'), F.lit(', "url": "'), url, F.lit('"'), F.when(k % 2 == 0, ', "page": 3').otherwise(', "page": "x"'), F.when(k % 3 == 0, ', "excerpt": "cut ___ here"').otherwise(""), F.when(k % 17 == 0, "").otherwise("}}"))
    rows = staged(S.narrowed(p.select(raw.alias("raw"))), "narrowed")
    exact = F.when(F.col("id").cast("long") % 4 == 0, "exact")
    out = S.cards(rows, C.shown_text(F.coalesce("excerpt", "text")), exact)
    return out.join(S.chunks_for_model(rows).select("id", "text"), "id").select("id", "score", "page", "section", "excerpt", "anchor", "text")


def acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat("text", F.lit(" ["), F.upper("lang"), F.lit("] [x1] ["), F.upper(F.translate("source", "0123456789-_.", "")), F.lit("]")).alias("text"))
    return S.acronyms_printed(d)


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _captured(spark, sf_dir)
    k = F.col("source_id").cast("long")
    fresh = r.where(k % 4 != 0).select("source_id", F.when(k % 3 == 0, F.lit("ffff")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(k % 5 == 0, "2024-05-05").alias("updated"))
    once = S.stamped(r, fresh, "2025-01-01T00:00:00Z")
    return S.stamped(once, fresh, "2026-01-01T00:00:00Z").select("source_id", "content_hash", "captured_path", "captured_at", "source_updated_date")


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a refresh's report with their decisions after two were approved."""
    r = _captured(spark, sf_dir)
    k = F.col("source_id").cast("long")
    rows = r.select(F.col("source_id").alias("source"), F.when(k % 3 == 0, "changed").when(k % 3 == 1, "manual-check-required").otherwise("unchanged").alias("status"), F.concat(F.lit("reason <"), "source_id", F.lit("> & 'more'")).alias("reason"), F.col("content_hash").alias("old_hash"), F.when(k % 3 != 1, "abcd").alias("new_hash"))
    lines = S.review_lines(rows)
    decided = S.approved_ids(lines.select("source", "decision"), ["3", "6"])
    return lines.drop("decision").join(decided, "source").withColumn("line", S.escaped_html(F.col("line")))


def held_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of held documents by state, those with pictures, and stray files by name."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "wasm/").otherwise("app/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".wasm").otherwise(".js")).alias("file"))
    held = p.where("p_partkey % 4 = 0").select("p_partkey")
    known = p.join(held, "p_partkey", "left_semi").agg(F.sum("size").alias("n")).select(F.lit("held").alias("what"), "n")
    stray = p.where(F.col("file").endswith(".wasm") & ~F.col("file").startswith("wasm/")).agg(F.count("*").alias("n")).select(F.lit("stray").alias("what"), "n")
    return known.unionByName(stray)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    status = F.when(k % 10 == 0, "changed").when(k % 10 == 1, "manual-check-required").otherwise("unchanged")
    return d.select(F.col("doc_id").alias("source"), status.alias("status"), F.concat(F.lit("because "), "lang").alias("reason"), F.sha2("text", 256).alias("old_hash"), F.when(k % 10 != 1, F.sha2("lang", 256)).alias("new_hash"))


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of a refresh of the documents: heading, counts, lines."""
    return S.review_report(_changes(spark, sf_dir), "Refresh")


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a refresh in which nothing has changed."""
    return S.review_report(_changes(spark, sf_dir).withColumn("status", F.lit("unchanged")), "Refresh")


def image_paints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that pages paint: order lines as operators, and the orders that kept any as documents with pictures."""
    at = F.array(*map(F.lit, (*S.PAINTS, "fill", "save")))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.get(at, (F.col("l_partkey") % 5).cast("int")).alias("op"), (F.col("l_quantity") % 3).alias("w"), (F.col("l_suppkey") % 2 + 1).alias("h"))
    pages = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source")).agg(F.array_sort(F.collect_list(item)).alias("i"))
    kept = pages.select("source", S.image_paints(F.col("i.op"), F.col("i.w"), F.col("i.h")).alias("kept"))
    return kept.join(S.with_pictures(kept).withColumn("listed", F.lit(True)), "source", "left").na.fill(False, ["listed"])


QUERIES = {f"sources_{f.__name__}": f for f in (registry_faults, passage_faults, listed_items, after_links, library, categories, lacking, expected, image_counts, manifest, public_index, cited_urls, population, narrowed, acronyms, stamped, review, held_bytes, review_report, clean_report, image_paints)}

from .text import _canonical_sql  # noqa: E402

_R = """r AS (SELECT s_suppkey AS k, 'src_' || (s_suppkey % 97) || CASE WHEN s_suppkey % 31 = 0 THEN '-X' ELSE '' END AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'pdf' WHEN s_suppkey % 41 = 0 THEN 'doc' ELSE 'html' END AS kind, CASE WHEN s_suppkey % 6 = 0 THEN CASE WHEN s_suppkey % 18 = 0 THEN 'bad' ELSE 'good' END WHEN s_suppkey % 9 = 0 THEN 'good' END AS doc, s_suppkey % 5 <> 0 AS included FROM supplier)"""
_FAULTS = (
    ("missing_field", "title", "k % 37 = 0"), ("missing_field", "copyright_status", "k % 43 = 0"), ("missing_field", "scrape_method", "k % 53 = 0"), ("bad_id", "source_id", "k % 31 = 0"),
    ("bad_url", "url", "k % 7 = 0 OR k % 11 = 0"), ("bad_tier", "legal_tier", "k % 5 <> 0 AND k % 47 = 0"), ("bad_content_type", "content_type", "kind = 'doc'"), ("bad_cadence", "update_check", "k % 59 = 0"),
    ("bad_date", "source_updated_date", "k % 19 = 0 OR k % 23 = 0"), ("missing_review", "reviewed_date", "included AND (k % 3 = 0 OR k % 13 = 0)"), ("missing_review", "terms_reviewed_date", "included AND k % 17 = 0"),
    ("html_served", "served", "k % 4 = 0 AND kind <> 'pdf'"), ("served_not_cleared", "redistribution_cleared", "k % 4 = 0 AND NOT (k % 16 = 0)"), ("pdf_no_document_url", "document_url", "kind = 'pdf' AND doc IS NULL"), ("bad_url", "document_url", "kind = 'pdf' AND doc = 'bad'"), ("html_document_url", "document_url", "kind = 'html' AND doc IS NOT NULL"),
)
_C = "c AS (SELECT s_suppkey AS k, left(sha256(s_suppkey::VARCHAR), 8) AS h, (DATE '2024-01-05' + (s_suppkey % 300)::INT)::VARCHAR || 'T10:00:00Z' AS at_ FROM supplier)"

ORACLES = {
    "sources_registry_faults": f"WITH {_R}, f AS (" + " UNION ALL ".join(f"SELECT source_id, '{c}' AS code, '{f}' AS field FROM r WHERE {w}" for c, f, w in _FAULTS) + " UNION ALL SELECT source_id, 'dup_id', 'source_id' FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id) AS i FROM r) WHERE i > 1) SELECT source_id, code, field, count(*) AS n FROM f GROUP BY ALL",
    "sources_passage_faults": f"WITH c AS (SELECT doc_id AS k, 'd' || doc_id AS source, {_canonical_sql('text')} AS t FROM documents), a AS (SELECT *, CASE WHEN k % 3 = 0 THEN substr(t, 5, 40) WHEN k % 3 = 1 THEN substr(t, 3, 2) WHEN k % 9 = 2 THEN 'not there @@' END AS a, CASE WHEN k % 11 <> 0 THEN t END AS s, CASE WHEN k % 13 = 0 THEN 'BAD' ELSE 'src' END || left(sha256((k % 900)::VARCHAR), 12) || CASE WHEN k % 5 = 0 THEN '-1' ELSE '' END AS id FROM c), p AS (SELECT *, CASE WHEN a <> '' THEN coalesce(instr(s, a), 0) ELSE 0 END AS f FROM a), f AS (SELECT source, CASE WHEN k % 7 = 0 THEN 'unknown_source' WHEN k % 17 = 0 THEN 'excluded_source' END AS code FROM p UNION ALL SELECT source, CASE WHEN k % 13 = 0 THEN 'bad_id' END FROM p UNION ALL SELECT source, CASE WHEN f = 0 THEN 'anchor_unresolved' WHEN instr(substr(s, f + 1), a) > 0 THEN 'anchor_ambiguous' END FROM p WHERE a IS NOT NULL UNION ALL SELECT min(source) OVER (PARTITION BY id), CASE WHEN row_number() OVER (PARTITION BY id ORDER BY k) > 1 THEN 'dup_id' END FROM p) SELECT source, code, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY ALL",
    "sources_listed_items": "SELECT s_suppkey, i - 1 AS pos, p_partkey AS id, p_name FROM supplier, range(1, 6) r(i) JOIN part ON p_partkey = s_suppkey * i * 7 % 300",
    "sources_after_links": "SELECT c_custkey AS key, CASE WHEN s_suppkey IS NOT NULL THEN 'go ' || c_custkey END AS label, 'https://x/' || s_suppkey AS url FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON c_custkey % 3 <> 0 AND s_suppkey = c_custkey % 40",
    "sources_library": "SELECT p_partkey AS source, '/docs/' || p_partkey AS path, p_name AS title, p_size::BIGINT AS bytes, CASE WHEN p_partkey % 4 = 0 THEN 'saved' ELSE 'unsaved' END AS state FROM part WHERE p_partkey % 6 = 0 AND p_partkey % 5 <> 0",
    "sources_categories": "SELECT p_brand, p_partkey, row_number() OVER w AS nth, min(p_partkey) OVER (PARTITION BY p_brand) AS first FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)",
    "sources_lacking": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)",
    "sources_expected": f"WITH d AS (SELECT doc_id, source, translate({_canonical_sql('text')}, '‘’“”', '''''\"\"') AS t FROM documents), q AS (SELECT doc_id AS query, source, translate({_canonical_sql('substr(text, (doc_id * 7919 % greatest(length(text) - 30, 1) + 1)::INT, 30)')}, '‘’“”', '''''\"\"') AS s FROM documents WHERE doc_id % 20 = 0) SELECT query, doc_id AS id FROM q JOIN d USING (source) WHERE contains(t, s)",
    "sources_image_counts": "WITH e AS (SELECT l_orderkey % 200 AS doc, l_linenumber::BIGINT AS page, l_quantity AS q FROM lineitem), k AS (SELECT doc, page, count(*) AS n FROM e WHERE q > 10 GROUP BY ALL), p AS (SELECT doc, page, count(*) AS n FROM e WHERE q > 11 AND page < 7 GROUP BY ALL) SELECT doc, page, coalesce(k.n, 0) AS expected, coalesce(p.n, 0) AS actual FROM k FULL JOIN p USING (doc, page) WHERE coalesce(k.n, 0) <> coalesce(p.n, 0)",
    "sources_manifest": "SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS served, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN '/docs/x' END AS served_path FROM part",
    "sources_public_index": f"WITH {_C} SELECT 't' || k AS title, CASE WHEN k % 3 <> 0 THEN 'https://x.gov/' || k END AS url, ['VA', 'DoD', 'TSP', 'DOL', 'DoD'][1 + k % 5] AS publisher, CASE WHEN k % 3 = 0 THEN 'guide' ELSE 'agency' END AS kind FROM c UNION ALL SELECT strftime(min(at_[1:10])::DATE, '%b %-d, %Y'), 'https://lib.gov', strftime(max(at_[1:10])::DATE, '%b %-d, %Y'), 'all' FROM c",
    "sources_cited_urls": "SELECT o_orderkey, (o_orderkey % 120)::VARCHAR AS source_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 6 - 1 END AS page, CASE WHEN s_suppkey IS NOT NULL THEN 'https://d.gov/' || s_suppkey || CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 6 - 1 >= 1 THEN '#page=' || (o_orderkey % 6 - 1) ELSE '' END END AS url FROM orders LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON s_suppkey = o_orderkey % 120",
    "sources_population": "WITH s AS (SELECT source FROM documents WHERE doc_id % 2 = 0 GROUP BY source HAVING count(*) % 2 = 0) SELECT doc_id, source, coalesce(doc_id % 4 = 1 AND lang <> '', false) AS anchored FROM documents WHERE doc_id % 3 <> 0 AND source IN (SELECT source FROM s)",
    "sources_narrowed": "SELECT p_partkey::VARCHAR AS id, ('0.' || (p_partkey % 9 + 1))::DOUBLE AS score, CASE WHEN p_partkey % 2 = 0 THEN 3 END::BIGINT AS page, NULL::VARCHAR AS section, CASE WHEN p_partkey % 3 = 0 THEN 'cut here' ELSE 'of - it' END AS excerpt, CASE WHEN p_partkey % 4 = 0 THEN 'exact' ELSE 'page 2 of • it' END AS anchor, 'page 2 of • it' AS text FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0",
    "sources_acronyms": "SELECT DISTINCT a AS acronym FROM (SELECT unnest(regexp_extract_all(text || ' [' || upper(lang) || '] [x1] [' || upper(translate(source, '0123456789-_.', '')) || ']', '\\[([A-Za-z0-9_.:-]+)\\]', 1)) AS a FROM documents) WHERE regexp_full_match(a, '[A-Z]+')",
    "sources_stamped": f"WITH {_C} SELECT k::VARCHAR AS source_id, CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN 'ffff' ELSE h END AS content_hash, CASE WHEN k % 4 <> 0 THEN 'captures/' || CASE WHEN k % 3 = 0 THEN 'ffff.pdf' ELSE h || '.html' END ELSE 'captures/old' END AS captured_path, CASE WHEN k % 4 <> 0 AND k % 3 = 0 THEN '2025-01-01T00:00:00Z' ELSE at_ END AS captured_at, CASE WHEN k % 4 <> 0 AND k % 5 = 0 THEN '2024-05-05' ELSE '2023-01-01' END AS source_updated_date FROM c",
    "sources_review": f"WITH {_C}, s AS (SELECT *, CASE k % 3 WHEN 0 THEN 'changed' WHEN 1 THEN 'manual-check-required' ELSE 'unchanged' END AS status FROM c) SELECT k::VARCHAR AS source, status, CASE WHEN k IN (3, 6) THEN 'approved' ELSE 'pending' END AS decision, '## ' || k || ' (' || status || ')' || chr(10) || 'reason &lt;' || k || '&gt; &amp; &#39;more&#39;.' || chr(10) || 'hash: ' || h || ' -&gt; ' || CASE WHEN k % 3 = 1 THEN '(unfetched)' ELSE 'abcd' END AS line FROM s",
    "sources_held_bytes": "SELECT 'held' AS what, sum(p_size)::BIGINT AS n FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'stray', count(*) FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 <> 0",
    "sources_review_report": "WITH c AS (SELECT doc_id AS source, CASE doc_id % 10 WHEN 0 THEN 'changed' WHEN 1 THEN 'manual-check-required' ELSE 'unchanged' END AS status, lang, sha256(text) AS o, CASE WHEN doc_id % 10 <> 1 THEN sha256(lang) END AS n FROM documents) SELECT 0 AS ord, NULL::BIGINT AS source, '# Refresh' AS line UNION ALL SELECT 1, NULL, 'changed: ' || count(*) FILTER (status = 'changed') || ', manual-check-required: ' || count(*) FILTER (status = 'manual-check-required') || ', unchanged: ' || count(*) FILTER (status = 'unchanged') FROM c UNION ALL SELECT 3, source, '## ' || source || ' (' || status || ')' || chr(10) || 'because ' || lang || '.' || chr(10) || 'hash: ' || o || ' -> ' || coalesce(n, '(unfetched)') FROM c WHERE status <> 'unchanged'",
    "sources_clean_report": "SELECT 0 AS ord, NULL::BIGINT AS source, '# Refresh' AS line UNION ALL SELECT 1, NULL, 'changed: 0, manual-check-required: 0, unchanged: ' || count(*) FROM documents UNION ALL SELECT 2, NULL, 'nothing to review'",
    "sources_image_paints": "SELECT l_orderkey AS source, count(*) FILTER (l_partkey % 5 < 3 AND l_quantity % 3 * (l_suppkey % 2 + 1) > 1) AS kept, count(*) FILTER (l_partkey % 5 < 3 AND l_quantity % 3 * (l_suppkey % 2 + 1) > 1) > 0 AS listed FROM lineitem GROUP BY 1",
}
