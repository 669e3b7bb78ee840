"""Queries that rank vectors and documents, and that measure such ranks. Every twentieth vector and all benchmark items ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.common import table

ALPHAS, MIN_BM25S, MIN_SCORES = (0.0, 0.5, 1.0), (0.0, 3.0), (0.0, 0.3)
CUTOFFS = tuple(c / 20 for c in range(20))


def _lists(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, id, rank, score, label, wanted): the first k others of each asking vector, with both labels."""
    v = table(spark, sf_dir, "embeddings")
    found = R.vector_top_k(v, v.where("vec_id % 20 = 0"), k + 1).where("id <> query_id")
    found = R.ranked(found.drop("rank"), "query_id", "score", "id", k)
    labels = v.select(F.col("vec_id").alias("id"), "label")
    return found.join(labels, "id").join(labels.toDF("query_id", "wanted"), "query_id")


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


def above_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.above(_lists(spark, sf_dir, 5), 0.3)
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"))


def list_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of asking vectors with one of their label among the first five others, and mean reciprocal rank over all."""
    v = table(spark, sf_dir, "embeddings")
    measures = E.measures_of_ranks(R.first_match_ranks(v, v.where("vec_id % 20 = 0"), "label"), 5)
    return measures.select("n", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of twenty with made-up lexical scores; queries whose id is divisible by sixty expect nothing."""
    rows = _lists(spark, sf_dir, 20)
    return rows.select("query_id", "id", F.round("score", 6).alias("cosine"), ((F.col("id") * 7 + F.col("query_id")) % 13).cast("double").alias("bm25"), (F.col("label") == F.col("wanted")).alias("relevant"), (F.col("query_id") % 60 != 0).alias("positive"))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.fused(_scored(spark, sf_dir).drop("relevant", "positive").withColumn("cosine", F.round("cosine", 4)), 5, 0.5, 0.2, 3.0)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = E.grid_rates(_scored(spark, sf_dir), ALPHAS, MIN_BM25S, MIN_SCORES)
    return rates.select("combo", "alpha", "min_bm25", "min_score", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "correct_empty")])


def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_of_grid(E.grid_rates(_scored(spark, sf_dir), ALPHAS, MIN_BM25S, MIN_SCORES)).select("combo", "alpha", "min_bm25", "min_score")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir, 5)
    best = rows.groupBy("query_id").agg(F.max(F.when(F.col("label") == F.col("wanted"), F.round("score", 6))).alias("score"))
    return E.calibrated_cutoff(best, CUTOFFS, 0.5)


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark item, by scores rounded to six places."""
    d = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25_top_k(d, items, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document numbers and weights of all terms."""
    return R.bm25_statistics(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).select("term", "df", F.round("idf", 6).alias("idf"))


def similar_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").cast("double").alias("score"), F.col("text").alias("excerpt"))
    return R.similar_cards(R.ranked(d, "source", "score", "doc_id", 6)).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


def passages_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each source's documents in order, by their digest."""
    return R.source_digests(table(spark, sf_dir, "documents"))


def frozen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.split(table(spark, sf_dir, "conversations"), F.col("text"))
    return c.groupBy("held_out").agg(F.count("*").alias("n"), F.sum("bucket").cast("long").alias("buckets"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cutoff_candidates(table(spark, sf_dir, "events"), "value")


def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(E.upper_median(table(spark, sf_dir, "events"), "value"),)], "median double")


def paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 31).cast("long").alias("b"), F.col("s_nationkey").cast("long").alias("c"))
    return s.select("s_suppkey", F.round(E.sign_test(F.col("b"), F.col("c")), 9).alias("p"), E.bar_passed(F.col("b"), F.col("c"), False).alias("more"), E.bar_passed(F.col("b"), F.col("c"), True).alias("surely_more"))


QUERIES = {f"rank_{f.__name__}": f for f in (vector_search, above_cutoff, list_measures, hybrid, grid, grid_best, calibration, bm25, term_weights, similar_cards, passages_by_source, frozen_split, candidates, median, paired_test)}

_LISTS = """s AS (SELECT q.vec_id AS query_id, q.label AS wanted, v.vec_id AS id, v.label, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)"""
_SCORED = f"{_LISTS}, c AS (SELECT query_id, id, round(score, 6) AS cosine, ((id * 7 + query_id) % 13)::DOUBLE AS bm25, label = wanted AS relevant, query_id % 60 <> 0 AS positive FROM l WHERE rank <= 20)"
_GRID = f"""{_SCORED}, g AS (SELECT a.i * 4 + b.i * 2 + s.i AS combo, alpha, min_bm25, min_score FROM (VALUES (0, 0.0::DOUBLE), (1, 0.5), (2, 1.0)) a(i, alpha), (VALUES (0, 0.0::DOUBLE), (1, 3.0)) b(i, min_bm25), (VALUES (0, 0.0::DOUBLE), (1, 0.3)) s(i, min_score)),
t AS (SELECT *, max(bm25) OVER (PARTITION BY query_id) AS top FROM c),
f AS (SELECT *, cosine * alpha + CASE WHEN top > 0 THEN bm25 / top ELSE 0 END * (1 - alpha) AS score FROM t, g),
i AS (SELECT *, row_number() OVER (PARTITION BY combo, query_id ORDER BY round(score, 9) DESC, id) AS place FROM f WHERE bm25 >= min_bm25 AND score >= min_score),
e AS (SELECT g.*, q.query_id, q.positive, (SELECT min(place) FROM i WHERE i.combo = g.combo AND i.query_id = q.query_id AND place <= 5 AND relevant) AS first, EXISTS (SELECT 1 FROM i WHERE i.combo = g.combo AND i.query_id = q.query_id) AS found FROM g, (SELECT DISTINCT query_id, positive FROM c) q),
m AS (SELECT combo::BIGINT AS combo, alpha, min_bm25, min_score, round(coalesce(avg((first IS NOT NULL)::INT) FILTER (positive), 0), 6) AS hit_rate, round(coalesce(avg(coalesce(1 / first, 0)) FILTER (positive), 0), 6) AS mrr, round(coalesce(avg((NOT found)::INT) FILTER (NOT positive), 1), 6) AS correct_empty FROM e GROUP BY ALL)"""
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

ORACLES = {
    "rank_vector_search": f"WITH {_LISTS} SELECT query_id, rank, id, round(score, 6) AS score FROM l WHERE rank <= 5",
    "rank_above_cutoff": f"WITH {_LISTS} SELECT query_id, count(*) AS n, round(min(score), 6) AS least FROM l WHERE rank <= 5 AND score >= 0.3 GROUP BY query_id",
    "rank_list_measures": f"WITH {_LISTS}, q AS (SELECT query_id, min(rank) FILTER (label = wanted) AS first FROM l GROUP BY query_id) SELECT count(*) AS n, round(avg((coalesce(first <= 5, false))::INT), 6) AS hit_rate, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM q",
    "rank_hybrid": f"WITH {_SCORED}, t AS (SELECT *, max(bm25) OVER (PARTITION BY query_id) AS top FROM c), f AS (SELECT query_id, id, round(cosine, 4) * 0.5 + CASE WHEN top > 0 THEN bm25 / top ELSE 0 END * 0.5 AS score FROM t WHERE bm25 >= 3) SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f WHERE score >= 0.2) WHERE rank <= 5",
    "rank_grid": f"WITH {_GRID} SELECT * FROM m",
    "rank_grid_best": f"WITH {_GRID} SELECT combo, alpha, min_bm25, min_score FROM m ORDER BY round(hit_rate + mrr, 5) DESC, combo LIMIT 1",
    "rank_calibration": f"WITH {_LISTS}, b AS (SELECT query_id, coalesce(max(round(score, 6)) FILTER (label = wanted), -1) AS best FROM l WHERE rank <= 5 GROUP BY query_id), r AS (SELECT i / 20 AS cutoff, avg((best >= i / 20)::INT) AS rate FROM b, range(20) t(i) GROUP BY i) SELECT coalesce(max(cutoff) FILTER (rate >= 0.5), 0) AS cutoff FROM r",
    "rank_bm25": f"WITH d AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), p AS (SELECT id, len(w) AS length, unnest(w) AS term FROM d), c AS (SELECT id, length, term, count(*) AS tf FROM p GROUP BY ALL), i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c, n GROUP BY term, n), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), s AS (SELECT query_id, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN c USING (term) JOIN i USING (term), n GROUP BY query_id, id) SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5",
    "rank_term_weights": f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY term",
    "rank_similar_cards": "SELECT source, doc_id, rank FROM (SELECT source, doc_id, text AS excerpt, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank BETWEEN 2 AND 6 AND len(list_filter(regexp_split_to_array(excerpt, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) > 8",
    "rank_passages_by_source": "SELECT source, min(doc_id) AS first, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY source",
    "rank_frozen_split": "WITH b AS (SELECT (list_reduce(list_prepend(5381::BIGINT, flatten(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) < 65536 THEN [unicode(c)::BIGINT] ELSE [55296 + ((unicode(c) - 65536) >> 10)::BIGINT, 56320 + ((unicode(c) - 65536) & 1023)::BIGINT] END))), lambda h, c: (h * 33 + c) % 4294967296) % 100)::BIGINT AS bucket FROM conversations) SELECT bucket < 30 AS held_out, count(*) AS n, sum(bucket)::BIGINT AS buckets FROM b GROUP BY 1",
    "rank_candidates": "WITH v AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM events) SELECT DISTINCT unnest([0.0::DOUBLE, v[1 + floor(0.25 * (n - 1))::BIGINT], v[1 + floor(0.5 * (n - 1))::BIGINT], v[1 + floor(0.75 * (n - 1))::BIGINT]]) AS candidate FROM v",
    "rank_median": "SELECT list_sort(list(value))[1 + count(*) // 2] AS median FROM events",
    "rank_paired_test": "WITH t AS (SELECT s_suppkey, s_suppkey % 31 AS b, s_nationkey::BIGINT AS c FROM supplier), p AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END AS p FROM t) SELECT s_suppkey, round(p, 9) AS p, b > c AS more, b > c AND p < 0.05 AS surely_more FROM p",
}
