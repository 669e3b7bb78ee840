"""Edges of single operators: empty input, ties, cycles, bounds."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import decisions as D
from quillspark.functions import text as T
from quillspark.functions import urls as U
from quillspark.operators import evaluation as E
from quillspark.operators import registry as G
from quillspark.operators import retrieval as R
from quillspark.operators import stateful as S
from quillspark.operators import timeline as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_trigrams_of_short_and_empty_texts(spark):
    def grams(text):
        return T.trigrams(T.words(F.lower(F.lit(text))))

    assert one(spark, grams("a b")) == []
    assert one(spark, grams("A b c d")) == one(spark, grams("a B c D")) and len(one(spark, grams("A b c d"))) == 2
    assert one(spark, T.trigram_similarity(grams(""), grams(""))) == 1.0
    assert one(spark, T.trigram_similarity(grams("a b c"), grams(""))) == 0.0
    assert one(spark, T.trigram_similarity(grams("a b c d"), grams("a b c e"))) == 1 / 3


def test_canonical_text(spark):
    assert one(spark, T.canonical(F.lit("  ﬁne­ é-\n  tat x "))) == "fine état x"


def test_measures_of_nothing(spark):
    none = spark.createDataFrame([], "ranked array<long>, expected array<long>")
    assert E.hit_rate(none, 5).first()["hit_rate"] == 0.0
    assert E.mean_reciprocal_rank(none).first()["mrr"] == 0.0


def test_reciprocal_rank_is_not_cut(spark):
    lists = spark.createDataFrame([([1, 2, 3], [3]), ([1, 2], [9])], "ranked array<long>, expected array<long>")
    assert math.isclose(E.mean_reciprocal_rank(lists).first()["mrr"], 1 / 6)
    assert E.hit_rate(lists, 2).first()["hit_rate"] == 0.0


def test_sign_test(spark):
    for b, c, p in ((4, 1, 0.375), (0, 0, 1.0), (5, 5, 1.0), (10, 0, 2 / 1024)):
        assert math.isclose(one(spark, E.sign_test(F.lit(b), F.lit(c))), p)


def test_candidates_have_no_repeats(spark):
    values = spark.createDataFrame([(x,) for x in (1.0, 3.0, 5.0, 7.0)], "v double")
    assert [r[0] for r in E.cutoff_candidates(values, "v").orderBy("candidate").collect()] == [0.0, 1.0, 3.0, 5.0]
    assert [r[0] for r in E.cutoff_candidates(values.where("false"), "v").collect()] == [0.0]
    assert E.upper_median(values, "v") == 5.0


def test_vector_search_ties_go_to_the_lesser_id(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    got = R.vector_top_k(v, v.where("vec_id = 1"), 2).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(1, 1.0), (3, 1.0)]
    assert R.vector_top_k(v, v.where("false"), 2).count() == 0


def test_reachability_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (3, 9)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    assert sorted(r[0] for r in S.reachable(nodes.where("node = 1"), edges).collect()) == [1, 2, 3, 9]
    assert [tuple(r) for r in S.missing_targets(nodes, edges).collect()] == [(3, 9)]


def test_session_ends_after_exactly_the_pause(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t), (1, 2, t + dt.timedelta(minutes=14, seconds=59)), (1, 3, t + dt.timedelta(minutes=29, seconds=59))]
    got = S.sessions(spark.createDataFrame(rows, "who long, id long, ts timestamp"), "who", "ts", "id").orderBy("session").collect()
    assert [r["n"] for r in got] == [2, 1]


def test_mark_is_capped_and_never_goes_back(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t), (1, 2, t + dt.timedelta(days=1000)), (1, 3, t + dt.timedelta(days=1)), (1, 4, None)]
    got = S.marks(spark.createDataFrame(rows, "who long, id long, ts timestamp"), "who", "id", "ts").orderBy("id").collect()
    first = got[0]["mark"]
    assert [(r["mark"] - first) // S.DAY_MICROS for r in got] == [0, 365, 365, 365]
    assert [r["late"] for r in got] == [False, False, True, None]


def test_days(spark):
    faults = {"2024-02-30": "day", "2024-13-01": "month", "1850-01-01": "year", "24-1-1": "format", "2024-02-29": None}
    for text, fault in faults.items():
        assert one(spark, L.day_fault(F.lit(text))) == fault


def test_folded_lines(spark):
    text = "é" * 100
    got = one(spark, L.folded_line(F.lit(text)))
    assert all(len(x.encode()) <= 75 for x in got.split("\r\n"))
    assert got.replace("\r\n ", "") == text


def test_extraction_faults_trim_and_count_controls(spark):
    faults = lambda text, pages=1: one(spark, T.extraction_faults(F.lit(text).cast("string"), F.lit(pages)))
    assert faults(None) == faults("") == faults(" \n\xa0 ") == ["empty"]
    assert faults("x" * 99) == ["sparse"] and faults("x" * 100) == [] and faults("x" * 99, 0) == []
    assert faults("x" * 97 + "\x0b\x0c\x00") == ["garbled"] and faults("x" * 49 + "\x0b\x0c" + "x" * 49) == [] and faults("x" * 98 + "\x0b\x0c") == ["sparse"]
    assert faults("x" * 90 + "\t\n\r" * 4 + "x") == []
    assert faults("  " + "x" * 99 + "  ") == ["sparse"]


def test_heading_echo_keeps_case_conditions_and_words(spark):
    cut = lambda text, section: one(spark, T.heading_stripped(F.lit(text), F.lit(section).cast("string")))
    assert cut("Overview: The text", "Overview") == "The text"
    assert cut("overview The text", "Overview") == "overview The text"
    assert cut("Overviews of it", "Overview") == "Overviews of it"
    assert cut("If you served more", "If you served") == "If you served more"
    assert cut("Iffy \n\t- rest", "Iffy") == "rest"
    assert cut("Text", None) == "Text" and cut("Text", "") == "Text"


def test_citations_leave_printed_acronyms(spark):
    printed = F.array(F.lit("TOE"))
    bare = lambda text, p: one(spark, T.without_citations(F.lit(text), p))
    assert bare("Transfer [TOE] is [a:1] due [b:2] .", printed) == "Transfer [TOE] is due."
    assert bare("Transfer [TOE] is", F.array().cast("array<string>")) == "Transfer is"
    assert bare("2[id]0[id]2[id]5", printed) == "2025"


def test_coverage_reports_gaps_at_what_came_before(spark):
    texts = spark.createDataFrame([(1, "abc def ghi"), (2, "abc def ghi"), (3, "abc"), (4, "abc def"), (5, "  "), (6, "abc def ghi")], "doc int, text string")
    spans = spark.createDataFrame([(1, 0, 3), (1, 4, 7), (1, 8, 11), (2, 0, 3), (2, 8, 11), (4, 0, 5), (4, 4, 7), (6, 0, 7)], "doc int, start int, end int")
    got = {r["doc"]: (r["fault"], r["at"]) for r in G.span_faults(spans, texts, "doc").collect()}
    assert got == {2: ("gap", 3), 3: ("gap", 0), 4: ("overlap", 4), 6: ("gap", 7)}


def test_split_bucket_counts_utf16_units(spark):
    def djb2(text):
        h = 5381
        raw = text.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = (h * 33 + int.from_bytes(raw[k : k + 2], "big")) % 2**32
        return h % 100

    for text in ("ab", "", "é€", "a😀b"):
        assert one(spark, T.split_bucket(F.lit(text))) == djb2(text)
    assert one(spark, T.split_bucket(F.lit("ab"))) == 8


def test_sign_test_of_many(spark):
    assert 0 < one(spark, E.sign_test(F.lit(1000), F.lit(1200))) < 1e-4
    assert math.isclose(one(spark, E.sign_test(F.lit(2000), F.lit(2000))), 1.0)


def test_vectors_of_unequal_length_are_an_error(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="must have 2 elements"):
        R.vector_top_k(v, v.where("vec_id = 1"), 1).collect()


def test_first_match_ranks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.9, 0.1], 8), (3, [0.5, 0.5], 7), (4, [0.0, 1.0], 9)], "vec_id long, embedding array<float>, label long")
    got = {r["query_id"]: r["rank"] for r in R.first_match_ranks(v, v, "label").collect()}
    assert got == {1: 2, 2: None, 3: 2, 4: None}


def test_origins(spark):
    urls = ["https://A.gov/x", "https://a.gov:443/x", "http://u:p@a.gov:8080?x", "a.gov", None, "https://a.gov.evil.com"]
    got = [r for r in spark.createDataFrame([(u,) for u in urls], "u string").select(U.origin(F.col("u")).alias("o"), U.government_url(F.col("u")).alias("g")).collect()]
    assert [r["o"] for r in got] == ["https://a.gov", "https://a.gov", "http://a.gov:8080", "", "", "https://a.gov.evil.com"]
    assert [r["g"] for r in got] == [True, True, True, False, False, False]
    html = '<img src="https://a.gov/1"><img SRC = \'http://b.org/2\'><a href="https://c.org"><img src="/3">'
    assert one(spark, U.off_origin_urls(F.lit(html), F.lit("https://a.gov"))) == ["http://b.org/2"]


def test_personal_claims(spark):
    claims = ["You will be approved", "you\u2019re eligible", "ask whether your request is approved", "your request was approved", "who will approve your leave", "They will approve your leave", "The rate is set by law", "you have 30 days"]
    got = [one(spark, D.claims_personally(F.lit(x))) for x in claims]
    assert got == [True, True, False, True, False, True, False, True]


def test_paced_keeps_rows_without_group_or_time(spark):
    """A null group is a group; a request without a time waits null and takes no turn."""
    from quillspark.operators import sources as S

    rows = [("a", 1, 0), ("a", 2, 10), ("a", 3, None), (None, 4, 0), (None, 5, 5), (None, 6, None), ("a", 7, 61_000), ("a", 8, 61_000), ("b", 9, None)]
    got = {r["id"]: r["wait"] for r in S.paced(spark.createDataFrame(rows, "host string, id int, at long"), "host", "id", "at", 100).collect()}
    assert got == {1: 0, 2: 90, 3: None, 4: 0, 5: 95, 6: None, 7: 0, 8: 100, 9: None}
