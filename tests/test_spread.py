"""Work on rows is spread over tasks and done once, and Python gets bounded batches of what it must see alone."""

import contextlib
import io
import math
import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking as C
from quillspark.operators import cleaning as L
from quillspark.operators import common
from quillspark.operators import sources as S
from quillspark.plans import catalog


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_tables_bound_batches(spark, sf):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    common.table(spark, sf, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == common.BATCH_ROWS


def test_one_file_is_dealt_to_many_tasks(spark, sf):
    least = 2 * spark.sparkContext.defaultParallelism
    assert common.spread(common.table(spark, sf, "documents")).rdd.getNumPartitions() >= least
    for name in ("passages_shown", "text_snippets", "text_extraction_sanity", "records_backups", "pages_sections", "passages_passages", "passages_cleaned_blocks"):
        assert "RoundRobinPartitioning" in plan_of(catalog.QUERIES[name](spark, sf)), name


def test_composition(spark):
    texts = [None, "", "plain", "café", "café ", "가", "̈́", "Å", "\U0001d15e"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["c"] for r in df.select(T.composed(F.col("t")).alias("c")).collect()]
    assert got == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert all(unicodedata.normalize("NFC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) for c in range(0x300))
    assert "nfc(CASE WHEN" in plan_of(df.select(T.composed(F.col("t"))))


def test_white_space(spark):
    texts = ["a b", " a  b ", "a\tb", "a  b\n\nc", "　", "", "  ", "x \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda t: __import__("re").sub(f"[{T.SPACES}]+", " ", t).strip(" ")
    assert [r["c"] for r in df.select(T.collapsed(F.col("t")).alias("c")).collect()] == [plain(t) for t in texts]
    assert [r["c"] for r in df.select(T.trimmed(F.col("t")).alias("c")).collect()] == [__import__("re").sub(f"^[{T.SPACES}]+|[{T.SPACES}]+$", "", t) for t in texts]


def test_units_and_buckets(spark):
    texts = [None, "", "ab", "a\U0001f600b", "￿" * 3000, "\U0001f600" * 2500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(T.n_units(F.col("t")).alias("n"), T.split_bucket(F.col("t")).alias("b")).collect()

    def bucket(t):
        h, raw = 5381, t.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 33 + raw[k] * 256 + raw[k + 1]) % 2**32
        return h % 100

    assert [r["n"] for r in rows] == [None if t is None else len(t.encode("utf-16-be")) // 2 for t in texts]
    assert [r["b"] for r in rows] == [None if t is None else bucket(t) for t in texts]
    assert "aggregate(" not in plan_of(df.select(T.split_bucket(F.col("t"))))


def test_shown_patterns_at_every_start(spark):
    cases = {"a EFCT PARTICIPANT GUIDE | SECTION 1 | PAGE 14 b": "a b", "|SECTION 2| b": "b", " | SECTION 1 | 3b": "b", "Module 1: Course Capstone x": "x", "a　Module 2: Getting Career Ready": "a", "page 3A b page4C": "A b C", "x•• y": "x - y", "a ■ b": "a - b", "a  b": "a b"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r["c"] for r in df.select(C.shown_text(F.col("t")).alias("c")).collect()] == list(cases.values())


def test_json_is_parsed_once(spark):
    df = spark.createDataFrame([('{"score": 1, "chunk": {"id": "a", "text": "t", "sourceId": "s", "sourceTitle": "T", "url": "https://va.gov/x"}}',), ("{",), (None,)], "raw string")
    out = S.narrowed(df)
    assert [(r["id"], r["score"], r["page"]) for r in out.collect()] == [("a", 1.0, None)]
    assert plan_of(out).count("parseJson") == 1


def test_a_block_is_finished_once(spark):
    rows = [(1, k, t, 1) for k, t in enumerate(["Read on. JOB QUIZ TRUE FALSE 1 2", " quiz ", "QUIZ true false x", "plain"])]
    out = L.cleaned(spark.createDataFrame(rows, "id long, ord int, text string, page int"))
    assert [r["text"] for r in out.orderBy("ord").collect()] == ["Read on.", "quiz", None, "plain"]
    assert plan_of(L.rebuilt(out)).count("FALSE") == 1
    assert math.isclose(1.0, out.agg(F.max("confidence")).first()[0])
