"""Queries against their SQL where the small tables have no rows that tell a difference."""

import datetime as dt
import hashlib
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.plans import catalog
from tests.oracle import TABLES, same


def tables(sf, folder, **other):
    """A folder of the small tables with some of them in another form."""
    for t in TABLES:
        if t in other:
            pq.write_table(other[t], f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{sf}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def test_intervals_take_the_nearest_millisecond(spark, sf, tmp_path):
    """Half a millisecond is a whole one, before 1970 too."""
    micros = [0, 400, 499, 500, 999_600, 1_400_499, 1_400_500, -500, -499, -1_500, -1_501, 2_000_000_499]
    rows = pa.table({"event_id": pa.array(range(len(micros)), pa.int64()), "ts": pa.array([dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=m) for m in micros], pa.timestamp("us")), "user_id": pa.array([3] * len(micros), pa.int64()), "event_type": ["view"] * len(micros), "value": [1.0] * len(micros), "props": ["{}"] * len(micros)})
    assert same(spark, catalog.QUERIES["pages_intervals"], catalog.ORACLES["pages_intervals"], tables(sf, tmp_path, events=rows)) == len(micros)


def test_a_source_has_one_digest_of_all_ids(spark):
    """However many ranges its ids are in; rows without an id count, a null source is one, without ids there is no digest."""
    ids = [(("a", "b", None)[i % 3], i * 700) for i in range(20)] + [("a", None), ("c", None), ("a", 700 * 3)]
    got = {r["source"]: (r["first"], r["n"], r["digest"]) for r in R.source_digests(spark.createDataFrame(ids, "source string, doc_id long")).collect()}
    want = {}
    for s in {s for s, _ in ids}:
        own = sorted(i for t, i in ids if t == s and i is not None)
        want[s] = (own[0] if own else None, sum(t == s for t, _ in ids), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() if own else None)
    assert got == want
    made = catalog.QUERIES["rank_passages_by_source"](spark, "/root/testdata/sf0.001")
    assert made.columns == ["source", "first", "n", "digest"] and made.count() == made.select("source").distinct().count()


def test_the_best_texts_are_those_of_all_scores(spark):
    """Copies are ranked by id, a missing id is the first, rows that share an id are one; a task keeps a few for each query."""
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = [(i // 2 if i < 6 else i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(300)] + [(1000 - i, "w1 w2 w3 w4") for i in range(60)] + [(None, "w1 w2 w3 w4")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=3))) for q in range(20)] + [(20, "w1 w2 w3 w4"), (21, "none")], "query_id long, query string")
    want = R.ranked(R.bm25_scores(docs, asked).withColumn("score", F.round("score", 6)), "query_id", "score", "id", 7).select("query_id", "rank", "id", "score")
    for size in (R.QUERY_BYTES, 2_000):
        was, R.QUERY_BYTES = R.QUERY_BYTES, size
        try:
            got = R.bm25_top_k(docs, asked, 7)
        finally:
            R.QUERY_BYTES = was
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
