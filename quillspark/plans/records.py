"""Queries over records: canonical JSON and signatures, encryption, stored states and backups, approvals, paged texts, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as J
from ..functions import text as T
from ..operators import registry as G
from ..operators import retrieval as R
from ..operators import stateful as S
from ..operators.common import spread, table
from ..sources import artifact as A

KEY = b"0123456789abcdef"


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of conversations' turns with their keys in two orders, and their signatures."""
    c = table(spark, sf_dir, "conversations")
    one = F.to_json(F.struct("turn", "text", "conv_id"))
    other = F.to_json(F.struct("conv_id", "text", "turn"))
    t = c.select("conv_id", "turn", J.canonical_json(one).alias("json"), J.signed(F.col("role"), one, KEY).alias("a"), J.signed(F.col("role"), other, KEY).alias("b"))
    return t.select("conv_id", "turn", F.sha2("json", 256).alias("digest"), (F.col("a") == F.col("b")).alias("same"))


def encryption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come back from encryption, and don't where what they are bound to has changed."""
    c = table(spark, sf_dir, "conversations")
    bound = lambda generation: J.bound_to(F.lit("turns"), F.col("conv_id"), generation, F.lit(1))
    iv = F.substring(F.unhex(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256)), 1, 12)
    blob = c.select("conv_id", "turn", "text", J.encrypted(F.col("text"), KEY, iv, bound(F.col("turn"))).alias("blob"))
    return blob.select("conv_id", "turn", F.octet_length("blob").cast("long").alias("size"), (J.decrypted(F.col("blob"), KEY, bound(F.col("turn"))).cast("string") == F.col("text")).alias("back"), J.decrypted(F.col("blob"), KEY, bound(F.col("turn") + 1)).isNull().alias("held"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    v = F.array(F.lit("a"), F.when(k % 3 == 0, "a").otherwise("b"), F.when(k % 5 == 0, "z").when(k % 7 != 0, "c"))
    return p.select("p_partkey", F.array_join(J.known_list(v, ["a", "b", "c"]), ",").alias("list"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read of stored states, one made of each customer."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"schemaVersion": '), F.when(k % 9 == 0, "2").otherwise("1"), F.lit(', "tasks": {"a": {"status": "'), F.when(k % 2 == 0, "snoozed").otherwise("done"), F.lit('"'), F.when(k % 4 == 0, ', "snoozeUntil": "2024-02-30"').when(k % 6 == 0, ', "snoozeUntil": "2024-02-29"').otherwise(""), F.lit('}, "b": {"notes": '), F.when(k % 5 == 0, "7").otherwise('"n"'), F.lit("}}"), F.when(k % 11 == 0, "").otherwise("}"))
    t = c.select("c_custkey", J.stored_tasks(text).alias("t"))
    return t.select("c_custkey", F.size("t").alias("n"), F.try_element_at("t", F.lit("a"))["status"].alias("status"), F.try_element_at("t", F.lit("a"))["until"].alias("until"))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals that fit what went in and came out, stamps of captures, the stage of a corpus's vectors, and its pending gates."""
    d = table(spark, sf_dir, "documents")
    k, h = F.col("doc_id"), F.sha2("text", 256)
    old = F.when(k % 3 == 0, F.sha2("lang", 256)).when(k % 7 != 0, h)
    ok = G.approved(h, F.sha2("lang", 256), F.when(k % 5 != 0, h), F.when(k % 4 != 0, F.sha2("lang", 256)))
    return d.select("doc_id", ok.alias("approved"), G.capture_stamp(old, F.when(k % 11 != 0, "2024"), h, F.lit("2025")).alias("stamp"), G.embedding_stage(h, old).alias("embed"))


def paged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together from items of a line each, five to a page; those of each sixth document are empty."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    items = d.select("doc", F.floor(F.col("ord") / 5).alias("page"), "ord", F.when(F.col("doc") % 6 != 0, F.col("text")).otherwise("").alias("text"), (F.col("ord") % 2 == 0).alias("ends_line"))
    _, whole = A.paged_texts(items)
    return whole.select("doc", F.sha2("text", 256).alias("digest"), "scanned")


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as optimistic writes to a state of each third customer."""
    state = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 4).cast("long").alias("generation"), F.lit("old").alias("value"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 4).cast("long").alias("generation"), F.col("o_orderkey").cast("string").alias("value"))
    return S.written(state, new)


def files_by_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    least = c.agg(F.min("node")).first()[0] or 0
    nodes = c.select("node", (F.col("node") % 50 == 0).alias("entry"), (F.col("node") % 37).alias("file"))
    edges = c.where(F.col("node") > least).select(F.col("node").alias("src"), F.greatest(F.floor(F.col("node") / 2), F.lit(least)).cast("long").alias("dst"))
    return S.split_by_reach(nodes, edges)


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of the first vector of each query's label over the whole ranking, and how the query reads: HIT, SRC or MISS."""
    v = table(spark, sf_dir, "embeddings")
    ranks = R.first_match_ranks(v, v.where("vec_id % 20 = 0"), "label")
    return ranks.select("query_id", "rank", F.when(F.col("rank") <= 1, "HIT").when(F.col("rank") <= 5, "SRC").otherwise("MISS").alias("reads"))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "'\"", "’“").alias("t"))
    return d.select("doc_id", F.sha2(T.straight_quotes(F.col("t")), 256).alias("digest"))


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a backup made of each customer is turned away: keys, versions, days, tasks and lists that fit or don't by turns."""
    k = F.col("c_custkey")
    some = lambda n, r, yes, no: F.when(k % n == r, yes).otherwise(no)
    text = F.concat(
        F.lit('{"backupSchema": '), some(17, 3, "2", "1"), F.lit(', "appVersion": "'), some(13, 5, "1.02.0", "1.2.0"), F.lit('", "createdAt": '), some(19, 4, "-1", "5"), some(23, 6, ', "more": 1', ""),
        F.lit(', "stores": {"profile": {"eaos": "'), some(11, 2, "2027-02-29", "2027-02-28"), F.lit('"}, "timeline-state": {"schemaVersion": 1, "tasks": {"'), some(7, 1, "z", "a"), F.lit('": {"status": "done"}}}, "calendar-sync": '),
        some(3, 0, "null", '{"schemaVersion": 1, "exclusions": {"taskIds": ["a"], "categories": []}}'), F.lit("}"), some(29, 8, "", "}"),
    )
    return spread(table(spark, sf_dir, "customer")).select("c_custkey", J.backup_fault(text, "9.0.0", ["a", "b"], ["c"]).alias("fault"))


QUERIES = {f"records_{f.__name__}": f for f in (signatures, encryption, lists, states, approvals, paged_texts, writes, files_by_reach, misses, folded, backups)}

from .retrieval import _LISTS  # noqa: E402
from .text import _canonical_sql  # noqa: E402

ORACLES = {
    "records_encryption": "SELECT conv_id, turn, strlen(text) + 28 AS size, true AS back, true AS held FROM conversations",
    "records_lists": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 THEN 'a,b,c' END AS list FROM part",
    "records_states": "WITH c AS (SELECT c_custkey AS k, c_custkey % 9 <> 0 AND c_custkey % 11 <> 0 AS ok, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'snoozed' ELSE 'done' END AS s FROM customer) SELECT k AS c_custkey, CASE WHEN ok THEN (s IS NOT NULL)::INT + (k % 5 <> 0)::INT END AS n, CASE WHEN ok THEN s END AS status, CASE WHEN ok AND s IS NOT NULL AND k % 6 = 0 THEN '2024-02-29' END AS until FROM c",
    "records_approvals": "WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 3 = 0 THEN sha256(lang) WHEN doc_id % 7 <> 0 THEN sha256(text) END AS old, sha256(text) AS h FROM documents) SELECT k AS doc_id, k % 5 <> 0 AND k % 4 <> 0 AS approved, CASE WHEN old IS NOT DISTINCT FROM h AND k % 11 <> 0 THEN '2024' ELSE '2025' END AS stamp, CASE WHEN old = h THEN 'skip' ELSE 'run' END AS embed FROM d",
    "records_paged_texts": f"WITH i AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents), p AS (SELECT doc_id, o // 5 AS page, string_agg(CASE WHEN doc_id % 6 <> 0 THEN t ELSE '' END || CASE WHEN o % 2 = 0 THEN chr(10) ELSE '' END, '' ORDER BY o) AS t, bool_or(doc_id % 6 <> 0 AND t <> '') AS has FROM i GROUP BY 1, 2), w AS (SELECT doc_id, string_agg({_canonical_sql('t')}, chr(10) ORDER BY page) AS t, bool_or(has) AS has FROM p GROUP BY doc_id) SELECT doc_id AS doc, sha256({_canonical_sql('t')}) AS digest, NOT has AS scanned FROM w",
    "records_writes": "WITH s AS (SELECT c_custkey AS key, c_custkey % 4 AS g FROM customer WHERE c_custkey % 3 = 0), w AS (SELECT o_custkey AS key, o_orderkey % 4 AS g, o_orderkey::VARCHAR AS v FROM orders), a AS (SELECT key, max(s.g) AS g, count(w.v) AS n, min(w.v) FILTER (w.g = coalesce(s.g, 0)) AS new FROM w FULL JOIN s USING (key) GROUP BY key) SELECT key, coalesce(g, 0) + (new IS NOT NULL)::INT AS generation, coalesce(new, CASE WHEN g IS NOT NULL THEN 'old' END) AS value, n > (new IS NOT NULL)::INT AS conflict FROM a",
    "records_files_by_reach": "WITH RECURSIVE m AS (SELECT min(c_custkey) AS m FROM customer), r AS (SELECT c_custkey AS node FROM customer WHERE c_custkey % 50 = 0 UNION SELECT greatest(node // 2, m) FROM r, m WHERE node > m) SELECT c_custkey % 37 AS file, bool_or(c_custkey IN (SELECT node FROM r)) AS reached FROM customer GROUP BY 1",
    "records_misses": f"WITH {_LISTS}, q AS (SELECT query_id, min(rank) FILTER (label = wanted) AS rank FROM l GROUP BY query_id) SELECT query_id, rank, CASE WHEN rank <= 1 THEN 'HIT' WHEN rank <= 5 THEN 'SRC' ELSE 'MISS' END AS reads FROM q",
    "records_folded": "SELECT doc_id, sha256(translate(translate(text, '''\"', '’“'), '‘’“”', '''''\"\"')) AS digest FROM documents",
    "records_backups": "SELECT c_custkey, CASE WHEN c_custkey % 29 = 8 THEN 'invalid' WHEN c_custkey % 17 = 3 THEN 'newer' WHEN c_custkey % 13 = 5 OR c_custkey % 19 = 4 OR c_custkey % 23 = 6 THEN 'invalid' WHEN c_custkey % 11 = 2 THEN 'profile' WHEN c_custkey % 7 = 1 THEN 'timeline' END AS fault FROM customer",
}
