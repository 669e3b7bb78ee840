"""Queries over sources and captures: documents are captures, a copy of them that differs by rule is the newer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..operators import fingerprints as P
from ..operators import registry as G
from ..operators.common import table
from .text import _canonical_sql

#: Made-up crawling rules: host, prefix, allow.
CRAWL = [("example.com", "/", False), ("example.com", "/en/", True), ("example.com", "/en/1", False), ("example.net", "/fr/", False), ("example.org", "/es", False), ("example.org", "/es", True)]


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("key", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    rules = [("https", F.col("url").startswith("https://")), ("host", F.col("key").rlike("\\.(com|net)$")), ("long", F.length("html") < 20_000)]
    return G.violations(p, "key", rules).groupBy("key", "code").agg(F.count("*").alias("n"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 7
    old = F.when(k != 5, F.sha2("text", 256))
    new = F.when(k == 0, F.sha2(F.concat("text", F.lit(".")), 256)).when(k != 1, F.sha2("text", 256))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    verdict = G.change(old, F.when(k != 2, day((F.col("doc_id") % 30).cast("int"))), new, day((F.col("doc_id") % 29).cast("int")), k == 6)
    return d.select("doc_id", verdict["verdict"].alias("change"), verdict["reason"].alias("reason"))


def build_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    got = G.stages(F.when(k != 0, F.col("lang")), F.when(k > 1, F.when(k == 2, F.lit("de")).otherwise(F.col("lang"))), k == 3, F.col("doc_id") % 2 == 0)
    return d.select("doc_id", *[c.alias(n) for n, c in got.items()])


def block_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents against the same documents with every a an o in lines that start with D, by canonical form."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    new = d.withColumn("content", F.when(F.col("content").startswith("D"), F.regexp_replace("content", "a", "o")).otherwise(F.col("content")))
    return G.block_difference(d, new, "doc_id", canonical(F.col("content"))).groupBy("doc_id", "side").agg(F.count("*").alias("n"))


def crawling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([a-z]+\\.(com|net|org))([/?#]|$)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    rules = spark.createDataFrame([(h, x, a, i) for i, (h, x, a) in enumerate(CRAWL)], "host string, prefix string, allow boolean, ord int")
    return G.path_allowed(p, rules).select("page_id", "allowed")


def revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of passages by id and text."""
    return P.revision(table(spark, sf_dir, "documents"), ["doc_id", "text"], "2026-01-31")


def _edited(d: DataFrame) -> DataFrame:
    """Documents of which some have another source, some are gone and one stands there twice."""
    source = F.when(F.col("doc_id") % 97 == 5, F.concat("source", F.lit("-moved"))).otherwise(F.col("source"))
    times = F.when(F.col("doc_id") % 101 == 7, 0).when(F.col("doc_id") % 103 == 9, 2).otherwise(1)
    return d.withColumn("source", source).withColumn("_i", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).drop("_i")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over whole rows: as they are, dealt anew in another order, and with edits that leave id and text alone."""
    d = table(spark, sf_dir, "documents")
    versions = {"as it is": d, "dealt anew": d.repartition("doc_id").sortWithinPartitions(F.desc("doc_id")), "edited": _edited(d)}
    out = [P.revision(df).select(F.lit(name).alias("version"), "revision", "n") for name, df in versions.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def differing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the edited version has otherwise, found by the leaves that differ."""
    d = table(spark, sf_dir, "documents")
    return P.differing_rows(d, _edited(d), "doc_id")


def _fingerprints_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources: extractions, approvals and passages of some of them."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.sha2("text", 256).alias("hash"))
    k = F.col("source")
    approvals = d.where(k % 3 != 0).select("source", F.when(k % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.get(F.array(*map(F.lit, ("approved", "pending", "rejected"))), (k % 5 % 3).cast("int")).alias("decision"))
    return G.source_fingerprints(d, d.where(k % 4 != 0), approvals, d.where(k % 2 == 0))


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build must do for each source, from what is known of it."""
    each, _ = G.chain_state(_fingerprints_of(spark, sf_dir), "a", "a")
    return each.withColumnRenamed("source", "doc_id")


def build_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to the vectors, and the sources that wait for a decision."""
    _, whole = G.chain_state(_fingerprints_of(spark, sf_dir), P.revision(table(spark, sf_dir, "documents")).first()["revision"], None)
    return whole.select("embed", "sources", "n_pending", F.array_join(F.transform("pending", lambda x: x.cast("string")), ",").alias("pending"))


def span_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(":"), F.substring(F.sha2("text", 256), 1, 12)).alias("base"))
    return G.unique_ids(d, "base", ["doc_id"]).select("doc_id", "id")


def running_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations under the last question of a user."""
    c = table(spark, sf_dir, "conversations")
    out = G.sections(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")))
    return out.select("conv_id", "turn", "section")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a hundred characters, some of which start early or late, over documents; each ninth has none, each seventh lacks
    its last."""
    d = table(spark, sf_dir, "documents")
    many = F.floor(F.length("text") / 100).cast("int") - F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    rows = d.where("doc_id % 9 <> 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(many, F.lit(0)))).alias("i"))
    k = F.col("doc_id") + F.col("i")
    shift = F.when((k % 97 == 0) & (F.col("doc_id") % 5 == 0), 3).when((k % 89 == 0) & (F.col("doc_id") % 5 == 1), -2).otherwise(0)
    spans = rows.select("doc_id", F.greatest(F.col("i") * 100 + shift, F.lit(0)).alias("start"), (F.col("i") * 100 + 100).alias("end"))
    return G.span_faults(spans, d, "doc_id").select("doc_id", "fault", F.col("at").cast("long").alias("at"))


def held_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    docs = c.select(F.col("conv_id").alias("doc")).distinct().withColumn("version", (F.col("doc") % 3).cast("string"))
    held = c.where("conv_id % 4 <> 0").select(F.col("conv_id").alias("doc"), (F.col("turn") % 2).cast("string").alias("version"))
    out = G.document_states(held, docs)
    return out.select("doc", "state", F.array_join("stale", ",").alias("stale"))


QUERIES = {f"registry_{f.__name__}": f for f in (schema_violations, changes, build_stages, block_changes, crawling, revision, fingerprints, differing_rows, source_states, build_gates, span_ids, running_sections, coverage, held_documents)}

_RULES = ", ".join(f"('{h}', '{x}', {a}, {i})" for i, (h, x, a) in enumerate(CRAWL))
_ROW = "to_json([doc_id::VARCHAR, lang, n_chars::VARCHAR, source, text])"
_EDITED = "edited AS (SELECT * REPLACE (CASE WHEN doc_id % 97 = 5 THEN source || '-moved' ELSE source END AS source) FROM documents, (VALUES (1), (2)) AS t(i) WHERE i <= CASE WHEN doc_id % 101 = 7 THEN 0 WHEN doc_id % 103 = 9 THEN 2 ELSE 1 END)"
_TREE = """r AS (SELECT version, sha256(j) AS row, count(*) AS times FROM v GROUP BY 1, 2),
sizes AS (SELECT version, count(*) AS n FROM r GROUP BY 1), depths AS (SELECT version, min(d) AS depth FROM sizes, range(0, 16) AS t(d) WHERE n <= 256 * 16 ** d GROUP BY 1),
up AS (SELECT version, left(row, depth) AS path, depth AS level, sha256(string_agg(row || ':' || times, ',' ORDER BY row)) AS digest, sum(times)::BIGINT AS n FROM r JOIN depths USING (version) GROUP BY 1, 2, 3
  UNION ALL SELECT version, left(path, level - 1), level - 1, sha256(string_agg(path || ':' || digest, ',' ORDER BY path)), sum(n)::BIGINT FROM up WHERE level > 0 GROUP BY 1, 2, 3)"""
_STATES = """k AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 4 <> 0 THEN sha256(text) END AS e, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END END AS f, doc_id % 3 <> 0 AND doc_id % 5 % 3 = 1 AS p FROM documents),
c AS (SELECT *, CASE WHEN f IS NULL OR f IS DISTINCT FROM e THEN 'run' WHEN p THEN 'gate-pending' ELSE 'skip' END AS clean FROM k),
s AS (SELECT doc_id, CASE WHEN e IS NULL THEN 'run' ELSE 'skip' END AS ingest, clean, CASE WHEN clean = 'skip' AND doc_id % 2 = 0 THEN 'skip' ELSE 'run' END AS chunk FROM c)"""
ORACLES = {
    "registry_schema_violations": "WITH p AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS key FROM pages), v AS (SELECT key, 'https' AS code FROM p WHERE NOT starts_with(url, 'https://') UNION ALL SELECT key, 'host' FROM p WHERE NOT regexp_matches(key, '\\.(com|net)$') UNION ALL SELECT key, 'long' FROM p WHERE length(html) >= 20000 UNION ALL SELECT key, 'duplicate' FROM (SELECT key, row_number() OVER (PARTITION BY key) AS i FROM p) WHERE i > 1) SELECT key, code, count(*) AS n FROM v GROUP BY key, code",
    "registry_changes": "WITH c AS (SELECT doc_id, doc_id % 7 AS k, CASE WHEN doc_id % 7 <> 5 THEN sha256(text) END AS o, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '.') WHEN doc_id % 7 <> 1 THEN sha256(text) END AS n, CASE WHEN doc_id % 7 <> 2 THEN doc_id % 30 END AS od, doc_id % 29 AS nd FROM documents) SELECT doc_id, CASE WHEN k = 6 THEN 'manual' WHEN n IS NOT NULL AND n <> coalesce(o, '') THEN 'changed' WHEN od IS NOT NULL AND nd > od THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN k = 6 THEN 'unfetchable' WHEN n IS NOT NULL AND n <> coalesce(o, '') THEN 'hash' WHEN od IS NOT NULL AND nd > od THEN 'date' END AS reason FROM c",
    "registry_build_stages": "WITH c AS (SELECT doc_id, doc_id % 5 AS k, CASE WHEN doc_id % 5 <> 0 THEN lang END AS e, CASE WHEN doc_id % 5 > 1 THEN CASE WHEN doc_id % 5 = 2 THEN 'de' ELSE lang END END AS f FROM documents), s AS (SELECT *, CASE WHEN f IS NULL OR f IS DISTINCT FROM e THEN 'run' WHEN k = 3 THEN 'gate-pending' ELSE 'skip' END AS clean FROM c) SELECT doc_id, CASE WHEN e IS NULL THEN 'run' ELSE 'skip' END AS ingest, clean, CASE WHEN clean = 'skip' AND doc_id % 2 = 0 THEN 'skip' ELSE 'run' END AS chunk FROM s",
    "registry_block_changes": f"WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM documents), n AS (SELECT doc_id, CASE WHEN starts_with(c, 'D') THEN replace(c, 'a', 'o') ELSE c END AS c FROM o), f AS (SELECT doc_id, {_canonical_sql('c')} AS c FROM o), g AS (SELECT doc_id, {_canonical_sql('c')} AS c FROM n) SELECT doc_id, side, count(*) AS n FROM (SELECT doc_id, 'removed' AS side FROM f WHERE (doc_id, c) NOT IN (SELECT doc_id, c FROM g) UNION ALL SELECT doc_id, 'added' FROM g WHERE (doc_id, c) NOT IN (SELECT doc_id, c FROM f)) GROUP BY doc_id, side",
    "registry_crawling": f"WITH p AS (SELECT page_id, regexp_extract(url, '([a-z]+\\.(com|net|org))([/?#]|$)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), h AS (SELECT page_id, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, i) AS n FROM p JOIN (VALUES {_RULES}) r(host, prefix, allow, i) ON p.host = r.host AND starts_with(path, prefix)) SELECT page_id, coalesce(allow, true) AS allowed FROM p LEFT JOIN (SELECT * FROM h WHERE n = 1) USING (page_id)",
    "registry_revision": f"WITH RECURSIVE v AS (SELECT 1 AS version, to_json([doc_id::VARCHAR, text]) AS j FROM documents), {_TREE} SELECT digest AS revision, n, (SELECT depth FROM depths)::INT AS depth, '2026-01-31' AS build_date FROM up WHERE level = 0",
    "registry_fingerprints": f"WITH RECURSIVE {_EDITED}, v AS (SELECT unnest(['as it is', 'dealt anew']) AS version, {_ROW} AS j FROM documents UNION ALL SELECT 'edited', {_ROW} FROM edited), {_TREE} SELECT version, digest AS revision, n FROM up WHERE level = 0",
    "registry_differing_rows": f"WITH {_EDITED}, o AS (SELECT doc_id, {_ROW} AS j, count(*) AS was FROM documents GROUP BY 1, 2), e AS (SELECT doc_id, {_ROW} AS j, count(*) AS now FROM edited GROUP BY 1, 2), b AS (SELECT doc_id, coalesce(was, 0) - coalesce(now, 0) AS more FROM o FULL JOIN e USING (doc_id, j)) SELECT doc_id, CASE WHEN more > 0 THEN 'removed' ELSE 'added' END AS side, abs(more) AS times FROM b WHERE more <> 0",
    "registry_source_states": f"WITH {_STATES} SELECT doc_id, ingest, clean, chunk FROM s",
    "registry_build_gates": f"WITH {_STATES}, w AS (SELECT doc_id FROM s WHERE clean = 'gate-pending') SELECT 'run' AS embed, count(*) AS sources, count(*) FILTER (clean = 'gate-pending') AS n_pending, (SELECT coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id), '') FROM (SELECT doc_id FROM w ORDER BY doc_id LIMIT 100)) AS pending FROM s",
    "registry_span_ids": "WITH b AS (SELECT doc_id, source || ':' || left(sha256(text), 12) AS base FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) - 1 AS k FROM b) SELECT doc_id, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS id FROM n",
    "registry_running_sections": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations",
    "registry_coverage": "WITH i AS (SELECT doc_id, unnest(range(0, greatest(length(text) // 100 - (doc_id % 7 = 0)::INT, 0) + 1)) AS i FROM documents WHERE doc_id % 9 <> 0), s AS (SELECT doc_id, greatest(i * 100 + CASE WHEN (doc_id + i) % 97 = 0 AND doc_id % 5 = 0 THEN 3 WHEN (doc_id + i) % 89 = 0 AND doc_id % 5 = 1 THEN -2 ELSE 0 END, 0) AS a, i * 100 + 100 AS b FROM i), l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS p FROM s), e AS (SELECT doc_id, a, b, p, false AS ending FROM l UNION ALL SELECT d.doc_id, length(text), NULL, coalesce(max(b), 0), true FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, text), f AS (SELECT e.doc_id, a, ending, CASE WHEN NOT ending AND a < p THEN 'overlap' WHEN regexp_matches(substr(text, p + 1, greatest(a - p, 0)), '[^\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]') THEN 'gap' END AS fault, p, b FROM e JOIN documents d USING (doc_id)), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ending, a, b) AS k FROM f WHERE fault IS NOT NULL) SELECT doc_id, fault, CASE fault WHEN 'gap' THEN p ELSE a END::BIGINT AS at FROM g WHERE k = 1",
    "registry_held_documents": "WITH d AS (SELECT DISTINCT conv_id AS doc, (conv_id % 3)::VARCHAR AS version FROM conversations), h AS (SELECT conv_id AS doc, list_sort(list(DISTINCT (turn % 2)::VARCHAR)) AS have FROM conversations WHERE conv_id % 4 <> 0 GROUP BY 1) SELECT doc, CASE WHEN list_contains(have, version) THEN 'held' WHEN len(have) > 0 THEN 'outdated' ELSE 'absent' END AS state, coalesce(array_to_string(list_filter(have, lambda x: x <> version), ','), '') AS stale FROM d LEFT JOIN h USING (doc)",
}
