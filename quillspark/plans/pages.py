"""Queries over web pages: blocks and sections of their text, checks of captures, robots files made of their hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import canonical
from ..operators import html as H
from ..operators import registry as G
from ..operators import sources as S
from ..operators.common import spread, table

#: Made-up robots files by the last digit of a page.
ROBOTS = (
    "User-agent: *\nDisallow: /en/\nAllow: /en/1 # all of it\n\nUser-agent: quill\nDisallow: /es/\nDisallow:\nAllow: /es/2",
    "# nothing\nUser-agent: other\nDisallow: /",
    "USER-AGENT: *\r\nDISALLOW: /\r\nAllow: /fr/",
    "Disallow: /lost\nUser-agent: Quillbot-longer\nDisallow: /\nUser-agent: *\nDisallow:",
)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost blocks of each page with their sections."""
    return H.shaped_blocks(H.raw_blocks(table(spark, sf_dir, "pages"))).select(F.col("id").alias("page_id"), "ord", "tag", "text", "section")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text, or why it has none."""
    out = H.extracted(table(spark, sf_dir, "pages"), U.origin(F.col("url")))
    return out.select(F.col("id").alias("page_id"), "fault", F.col("n_blocks").cast("long").alias("n_blocks"), F.sha2("text", 256).alias("digest"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section carry-forward over rows that stand for blocks: lines of documents, headings where a line is short."""
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    tagged = d.withColumn("tag", F.when(F.length("text") < 40, "h2").otherwise("p"))
    return H.shaped_blocks(tagged).groupBy(F.col("id").alias("doc_id"), "section").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


def telephones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What elements that show their attributes alone show."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    tag = F.when(k % 3 == 0, "VA-Telephone").otherwise("span")
    contact, extension = F.when(k % 4 != 0, F.concat(F.lit(" 555-"), k.cast("string"))), F.when(k % 2 == 0, " 7 ").when(k % 5 == 0, "")
    return p.select("page_id", S.component_text(tag, contact, extension).alias("shown"))


def audit_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    c = S.audit_copy(F.col("html"), F.lit("html"))
    notes = F.concat(F.lit("see file:  p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".PDF and more.pdf").otherwise(".txt"))
    return p.select("page_id", c["hash"].alias("hash"), c["path"].alias("path"), c["size"].alias("size"), S.staged_name(notes).alias("staged"))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages an agent may fetch under made-up robots files, one for each page's host."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4).cast("string").alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    files = spark.createDataFrame([(str(i), r) for i, r in enumerate(ROBOTS)], "host string, robots string")
    return G.path_allowed(p, S.robots_rules(files, "Quill/2.0")).select("page_id", "allowed")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long fetches of a host must wait so that they are a second apart, if they come when the events do, to the nearest millisecond."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("host"), "event_id", F.expr("round(unix_micros(cast(ts AS timestamp)), -3) div 1000").alias("at"))
    return S.paced(e, "host", "event_id", "at", 1000).select("event_id", "host", "wait")


QUERIES = {f"pages_{f.__name__}": f for f in (blocks, texts, sections, telephones, audit_copies, robots, intervals)}

_ALLOWED = {
    "0": "CASE WHEN starts_with(path, '/es/2') THEN true WHEN starts_with(path, '/es/') THEN false ELSE true END",
    "1": "true",
    "2": "CASE WHEN starts_with(path, '/fr/') THEN true WHEN starts_with(path, '/') THEN false ELSE true END",
    "3": "true",
}
from .text import _canonical_sql  # noqa: E402

ORACLES = {
    "pages_sections": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM documents), c AS (SELECT doc_id, o, length(t) < 40 AS head, {_canonical_sql('t')} AS t FROM l), s AS (SELECT *, last_value(CASE WHEN head THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS section FROM c WHERE t <> '') SELECT doc_id, section, count(*) AS n, sum(length(t))::BIGINT AS chars FROM s GROUP BY doc_id, section",
    "pages_telephones": "SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 4 <> 0 THEN '555-' || page_id || CASE WHEN page_id % 2 = 0 THEN ', ext. 7' ELSE '' END END AS shown FROM pages",
    "pages_audit_copies": "SELECT page_id, sha256(html) AS hash, 'captures/' || sha256(html) || '.html' AS path, strlen(html) AS size, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id || '.PDF' END AS staged FROM pages",
    "pages_robots": "WITH p AS (SELECT page_id, page_id % 4 AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) SELECT page_id, CASE h " + " ".join(f"WHEN {h} THEN {sql}" for h, sql in _ALLOWED.items()) + " END AS allowed FROM p",
    "pages_intervals": "WITH RECURSIVE e AS (SELECT user_id % 97 AS host, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id % 97 ORDER BY epoch_ms(ts), event_id) AS n FROM events), r AS (SELECT host, event_id, ms, n, ms AS go FROM e WHERE n = 1 UNION ALL SELECT e.host, e.event_id, e.ms, e.n, greatest(e.ms, r.go + 1000) FROM r JOIN e ON e.host = r.host AND e.n = r.n + 1) SELECT event_id, host, go - ms AS wait FROM r",
}
