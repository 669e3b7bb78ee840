import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import quality, queries

from .oracle import same


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, odd, documents):
    more = spark.createDataFrame([(90, "a b c a b c a b c\nx\n \nx\nx"), (91, "#a *b\n#a *b $%&|<>"), (92, "a b a b a")], "doc_id long, text string")
    for df in (odd.select("doc_id", "text"), documents.select("doc_id", "text"), more):
        for r in quality.with_counts(df, F.col("text")).collect():
            assert tuple(r[c] for c in quality.COUNTS) == counts(r["text"]), r["doc_id"]


def test_binomial_tail(spark):
    df = spark.createDataFrame([(0, 100), (3, 1000), (4, 1000), (5, 1000), (40, 9000), (0, 0), (0, 1)], "k long, n long").withColumn("n", F.col("n").cast("double"))
    for r in df.withColumn("t", quality.binomial_tail(F.col("k"), F.col("n"), 0.005)).collect():
        k, n = r["k"], int(r["n"])
        want = 1.0 if k > n * 0.005 else sum(math.comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(k + 1))
        assert r["t"] == pytest.approx(want, rel=1e-9)


def test_rules_switch_on_with_enough_labels(spark):
    """A rule that divides good from bad is certified on many labels, not on few, and stays off where it would cost too much."""
    good = "word " * 3 + " ".join(f"w{i}" for i in range(80))
    bad = " ".join(f"w{i}### %%%" for i in range(80))

    def docs(n, mixed):
        return spark.range(n).select(
            F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 4 == 0, bad).otherwise(good).alias("text"), F.when((F.col("id") % 4 == 0) & ~F.lit(mixed), 0).otherwise(1).alias("quality")
        )

    kept = lambda df: quality.judge(df.drop("quality"), df.select("doc_id", "quality")).groupBy((F.col("doc_id") % 4 == 0).alias("bad"), "kept").count().collect()
    assert {(r["bad"], r["kept"]) for r in kept(docs(8000, False))} == {(True, False), (False, True)}
    assert {(r["bad"], r["kept"]) for r in kept(docs(400, False))} == {(True, True), (False, True)}
    assert {(r["bad"], r["kept"]) for r in kept(docs(8000, True))} == {(True, True), (False, True)}


def test_against_sql(spark, sf):
    assert same(spark, queries.op4_quality_rules, quality.oracle(), sf)
    assert same(spark, queries.op4_quality_rules, quality.oracle(), "/root/testdata/sf0.01")


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == odd.count() and all(not (r["base_failed"] and r["kept"]) for r in got)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.judge(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0
    assert quality.judge(odd, labels.where("false")).count() == odd.count()
