"""Queries over artifacts on disk: vectors and texts written in files of their own form and read again, a corpus checked and opened."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline as T
from ..operators.common import scratch_path, table
from ..sources import artifact as A
from ..sources import blob as B
from . import timeline as plans

MODEL, VERSION = "made-up", "1"
#: Folders that calendars are dealt into: of a million, each has a thousand.
FOLDERS = 1024


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors written as raw floats and read again, as they are and made one long."""
    path = scratch_path(spark, "vectors")
    B.write_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path, VERSION, MODEL, 64)
    raw, unit = B.read_vectors(spark, path, VERSION, MODEL, unit=False), B.read_vectors(spark, path, VERSION, MODEL)
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    both = raw.join(unit.select("id", F.round(length, 3).alias("unit")), "id")
    return both.select(F.col("id").alias("vec_id"), "ord", F.round(length, 6).alias("length"), "unit")


def calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's calendar written as a file of its own: what the files hold."""
    path = scratch_path(spark, "calendars")
    texts = T.calendar(plans._events(spark, sf_dir), "person", dt.datetime(2000, 6, 1, 12)).select(F.concat(F.col("person").cast("string"), F.lit(".ics")).alias("name"), "text")
    B.write_texts(texts, path, FOLDERS)
    files = B.read_texts(spark, path)
    return files.select(F.regexp_extract("name", "([0-9]+)[.]ics$", 1).cast("long").alias("person"), F.sha2("content", 256).alias("digest"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages with vectors, written, checked and opened."""
    path = scratch_path(spark, "corpus")
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("url"), "lang")
    both = p.join(v, "id")
    A.write_artifact(both.drop("vector"), both.select("id", "vector"), path, MODEL, VERSION)
    out = A.open_artifact(spark, path, MODEL, VERSION)
    return out.select(F.col("id").alias("doc_id"), "lang", F.size("vector").cast("long").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("unit"))


QUERIES = {f"artifacts_{f.__name__}": f for f in (vectors, calendars, corpus)}

ORACLES = {
    "artifacts_vectors": "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ord, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS length, 1.0::DOUBLE AS unit FROM embeddings",
    "artifacts_calendars": plans.ORACLES["timeline_calendars"],
    "artifacts_corpus": "SELECT doc_id, lang, 64::BIGINT AS dim, 1.0::DOUBLE AS unit FROM documents JOIN embeddings ON vec_id = doc_id",
}
