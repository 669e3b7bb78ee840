"""A versioned corpus of passages and vectors on disk: written, checked and opened; texts of paged documents put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical


def write_artifact(passages: DataFrame, vectors: DataFrame, path: str, model: str, version: str) -> None:
    """Writes passages (id, url, ...) with their vectors (id, vector) to ``path``/passages and one row (version, model, dim, n) to
    ``path``/meta. Raises where a passage has no vector or a vector no passage, or vectors differ in length."""
    both = passages.join(vectors.select("id", "vector"), "id", "full")
    sizes = both.agg(F.count("*").alias("n"), F.count("vector").alias("v"), F.count("url").alias("p"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if not sizes["n"] == sizes["v"] == sizes["p"]:
        raise ValueError("passages and vectors don't go together")
    if sizes["low"] != sizes["high"]:
        raise ValueError("vectors differ in length")
    both.write.parquet(f"{path}/passages")
    passages.sparkSession.createDataFrame([(version, model, sizes["high"] or 0, sizes["n"])], "version string, model string, dim int, n long").write.parquet(f"{path}/meta")


def artifact_fault(spark: SparkSession, path: str, model: str, version: str) -> str | None:
    """The first thing wrong with an artifact: version, model, shape, length or url; None if nothing is."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != version:
        return "version"
    if meta["model"] != model:
        return "model"
    if not meta["dim"] > 0:
        return "shape"
    rows = spark.read.parquet(f"{path}/passages")
    state = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("vector") != meta["dim"], F.lit(True))).alias("odd"), F.count_if(~F.coalesce(F.lower("url").startswith("https://"), F.lit(False))).alias("urls")).first()
    return "length" if state["n"] != meta["n"] or state["odd"] else "url" if state["urls"] else None


def open_artifact(spark: SparkSession, path: str, model: str, version: str) -> DataFrame:
    """The passages with their vectors made one long; raises for an artifact that has a fault and for a zero vector."""
    fault = artifact_fault(spark, path, model, version)
    if fault:
        raise ValueError(f"the artifact's {fault} doesn't fit")
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = F.when(size > 0, size).otherwise(F.raise_error(F.lit("a vector is zero")))
    rows = spark.read.parquet(f"{path}/passages").withColumn("_size", size)
    return rows.withColumn("vector", F.transform("vector", lambda x: (x / F.col("_size")).cast("float"))).drop("_size")


def paged_texts(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From text items (doc, page, ord, text, ends_line): blocks (doc, page, text), one a page, and (doc, text, scanned): whole texts, and
    whether no item has any."""
    piece = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("ends_line"), "\n").otherwise(""))
    pages = items.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", piece.alias("t")))).alias("i"), F.max(F.length("text") > 0).alias("has"))
    pages = pages.select("doc", "page", canonical(F.array_join("i.t", "")).alias("text"), F.coalesce("has", F.lit(False)).alias("has"))
    whole = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"), (~F.max("has")).alias("scanned"))
    return pages.drop("has"), whole.select("doc", canonical(F.array_join("p.text", "\n")).alias("text"), "scanned")
