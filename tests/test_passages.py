"""Pages, sentences, passages, cleaning and places: literal cases and properties."""

import random
import time

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking as C
from quillspark.operators import cleaning as L
from quillspark.operators import html as H
from quillspark.operators import registry as G
from quillspark.operators import rules as R
from quillspark.operators import sources as S
from quillspark.plans import passages as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


PAGE = """<html><body><nav><p>menu</p></nav><article><p>not this</p></article>
<main><header><h1>gone</h1></header><h2>One <b>title</b></h2><p>Call us at <va-telephone contact="855-260-3274" extension=" 9 "></va-telephone>, see<a href="x">the page</a>.
<script>var x = "<p>no</p>";</script><ul><li>first <p>inner</p><li>second &amp; last</ul><img src="http://other.org/a.png"><aside><p>aside</p></aside><div>loose<blockquote>said</blockquote></div></main></body></html>"""


def test_page_blocks():
    got = H.page_blocks(PAGE, "https://www.va.gov/x")
    assert [t for t, _ in got] == ["h2", "p", "li", "li", "blockquote"]
    assert " ".join(got[0][1].split()) == "One title"
    assert " ".join(got[1][1].split()) == "Call us at 855-260-3274, ext. 9, see the page."
    assert [" ".join(x.split()) for _, x in got[2:]] == ["first inner", "second & last", "said"]
    assert H.page_blocks("<p>no region</p>", "https://a") is None and H.page_blocks("<article></article>", "") == []


def test_pages_as_rows(spark):
    df = spark.createDataFrame([(1, "https://www.va.gov/x", PAGE), (2, "https://b", None), (3, "https://c", "<main><p>see src='http://x.org/i' here</p></main>")], "page_id long, url string, html string")
    from quillspark.functions.urls import origin

    got = {r["id"]: r for r in H.extracted(df, origin(F.col("url"))).collect()}
    assert got[1]["n_blocks"] == 5 and got[1]["text"].startswith("One title Call us at") and got[2]["fault"] == "no_region" and got[3]["fault"] == "off_origin"
    assert {r["section"] for r in H.shaped_blocks(H.raw_blocks(df)).where("id = 1").collect()} == {"One title"}


def test_sentences(spark):
    text = 'Dr. Ito came. He said "Go." Then (see No. 5) he left!  9 went. e.g. this'
    got = one(spark, C.sentences(F.lit(text)))
    assert got == ["Dr. Ito came. ", 'He said "Go." ', "Then (see No. 5) he left!  ", "9 went. e.g. this"]
    assert one(spark, C.sentences(F.lit(""))) == [""] and one(spark, C.sentences(F.lit(None).cast("string"))) == [""]


def test_sentences_agree_with_the_chunker(spark):
    rng = random.Random(1)
    parts = ["No. ", "U.S. ", "Word ", "word. ", 'End." ', "A? ", "7 ", "etc. ", "fig.) ", "!! "]
    texts = ["".join(rng.choices(parts, k=40)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [r["t"][a:b] for a, b in C._cuts(r["t"], 0, len(r["t"]), True)] == [x for x in r["s"] if x]


def test_passages_cover_their_text():
    rng = random.Random(2)
    for _ in range(100):
        blocks = []
        for b in range(rng.randrange(1, 8)):
            words = [rng.choice(["Word", "word.", "a", "long,", "and:", "x\u2022", "TRUE:"]) for _ in range(rng.randrange(1, 60))]
            blocks.append((" ".join(words), rng.choice([None, "s", f"t{b}"]), b))
        text = " ".join(b for b, _, _ in blocks)
        got = C.passages_of(text, blocks, 20)
        at = 0
        for start, end, _, _, _ in got:
            assert not text[at:start].strip() and start < end
            at = end
        assert not text[at:].strip()
        # more than the target only where pieces that belong together were joined
        assert all(C.words_in(text[a:b]) <= 20 or ":" in text[a:b] or "," in text[a:b] for a, b, *_ in got)


def plain_passages(text, blocks, target):
    """Passages by looking at all words of all stretches; blocks without sentence ends, list signs or open clauses."""
    units, at = [], 0
    for block, section, page in blocks:
        at = text.index(block, at)
        ends = [i + 1 for i, c in enumerate(block) if c != " " and (i + 1 == len(block) or block[i + 1] == " ")]
        cuts = [0, *ends[target - 1 : -1 : target], len(block)]
        units += [[at + a, at + b, section, page, len(cuts) > 2] for a, b in zip(cuts, cuts[1:], strict=False)]
        at += len(block)
    out = []
    for u in units:
        if out and out[-1][2] == u[2] and len(text[out[-1][0] : u[1]].split()) <= target:
            out[-1] = [out[-1][0], u[1], u[2], out[-1][3], out[-1][4] or u[4]]
        else:
            out.append(u)
    return [(b - len(text[a:b].lstrip()), b, *rest) for a, b, *rest in out]


def test_passages_against_plain_counts():
    rng = random.Random(4)
    for _ in range(200):
        blocks = [(" ".join(rng.choice("abc") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))), rng.choice("st"), k) for k in range(rng.randrange(1, 6))]
        text = " ".join(b for b, _, _ in blocks)
        target = rng.randrange(1, 12)
        assert C.passages_of(text, blocks, target) == plain_passages(text, blocks, target)


def test_passages_take_linear_time():
    took = []
    for k in (4000, 16_000):
        blocks = [(f"w{i}, and", None, 1) for i in range(k)]
        start = time.perf_counter()
        assert len(C.passages_of(" ".join(b for b, _, _ in blocks), blocks)) == 1
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.2


def test_coverage_tells_of_texts_that_cant_be_cut(spark, sf, monkeypatch):
    """Every text has a row; one whose blocks aren't in it is uncut."""
    real = P._documents
    monkeypatch.setattr(P, "_documents", lambda s, d: real(s, d).withColumn("text", F.when(F.col("id") % 7 == 3, "x").otherwise(F.col("text"))))
    got = P.passage_coverage(spark, sf).collect()
    docs = real(spark, sf).count()
    assert len(got) == docs and {r["fault"] for r in got if r["doc_id"] % 7 == 3} == {"uncut"}
    assert {r["fault"] for r in got if r["doc_id"] % 7 != 3} == {None} and all(r["passages"] > 0 for r in got if r["doc_id"] % 7 != 3)


def test_passages_stay_within_sections_and_join_what_belongs_together():
    text = "One two. Three four. Claim here. TRUE: so. Next, and more follows"
    blocks = [("One two. Three four.", "a", 1), ("Claim here.", "b", 2), ("TRUE: so.", "b", 2), ("Next, and", "c", 3), ("more follows", "c", 3)]
    assert [(text[a:b], s, p) for a, b, s, p, _ in C.passages_of(text, blocks, 3)] == [("One two.", "a", 1), ("Three four.", "a", 1), ("Claim here. TRUE: so.", "b", 2), ("Next, and more follows", "c", 3)]
    words = "w1 w2 w3 w4 w5 w6 w7"
    assert [words[a:b] for a, b, *_ in C.passages_of(words, [(words, None, None)], 3)] == ["w1 w2 w3", "w4 w5 w6", "w7"]


def test_passages_as_rows(spark):
    df = spark.createDataFrame([(1, "a b", [("a b", None, 1)]), (2, "a b", [("c", None, 1)]), (3, None, None)], "id long, text string, blocks array<struct<text: string, section: string, page: int>>")
    got = {(r["id"], r["nth"]): (r["start"], r["end"]) for r in C.passages(df).collect()}
    assert got == {(1, 0): (0, 3), (2, -1): (None, None)}


def test_anchors():
    assert C.occurrences("aaa", "aa") == 2 and C.occurrences("aaa", "") == 0
    text = "the end. more of the end"
    assert C.anchor_of(text, 9, 13) == ("", "more", "")
    assert C.anchor_of(text, 0, 7) == ("", "the end", ".")
    assert C.anchor_of("ab ab", 0, 2, 0) is None
    for start, end in ((0, 3), (4, 7), (17, 20)):
        before, exact, after = C.anchor_of(text, start, end)
        assert C.occurrences(text, (before + exact + after).strip()) == 1


def test_passages_found_again():
    body = " ".join(f"word{k}" for k in range(120))
    broken = body[:700] + " Page 12 of the guide " + body[700:]
    start, end, coverage = C.located("before " + broken + " after", body.upper())
    assert (start, coverage) == (7, 1.0) and end == 7 + len(broken)
    assert C.located("other text", body) is None and C.located("", body) is None and C.located("x", "") is None
    assert C.located("the ofﬁce ", "office")[:2] == (4, 9)
    pages = ["nothing", body[:300], body[300:], "x"]
    assert [p for p, *_ in C.located_in_pages(pages, 2, body)] == [2, 3] and C.located_in_pages(pages, 9, body) == []


def test_matches_of_an_automaton_against_all_substrings():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(0, 25))) for _ in range(2))
        want = []
        for end in range(1, len(b) + 1):
            n = max((k for k in range(end + 1) if b[end - k : end] in a), default=0)
            longer = end < len(b) and b[end - n : end + 1] in a
            if n >= 2 and not longer:
                want.append((end - n, a.index(b[end - n : end]), n))
        assert C.Repeats(a).matches(b, 2) == want


def test_pages_around(spark):
    assert [one(spark, C.pages_around(F.lit(p), F.lit(5))) for p in (0, 1, 4, 6)] == [[], [1, 2, 3], [3, 4, 5], []]


def test_openings():
    assert C.opening("One two. Three four.", 3) == "One two."
    assert C.opening("a b - c d - e f", 4) == "a b - c d"
    assert C.opening("a b c d e", 3) == "a b c..." and C.opening("  ") == ""


def test_shown_text(spark):
    shown = lambda t: one(spark, C.shown_text(F.lit(t)))
    assert shown("A-160Version 6 1 Released March 2024, Revised July 2025 Text") == "Text"
    assert shown("x EFCT PARTICIPANT GUIDE | SECTION 1 | PAGE 14 y") == "x y"
    assert shown("\u2022 one \u2022\u2022 two \ue000") == "one - two"
    assert shown("page 1Mental Health and on page 5 of it") == "Mental Health and on page 5 of it"
    assert shown("items y first o second e third") == "items - first - second e third"
    assert shown("Module 5: Finding a Place to Live and Community Resources rest, Module 1, you") == "rest, Module 1, you"


def test_block_kinds(spark):
    rows = [
        ("Related Articles ", 1, "chrome"), ("Contents One 1 Two 2 Three 3", 1, "toc"), ("a .... 1 " * 9, 9, "toc"), ("blank .... " * 9, 9, "content"), ("Guide Version 6.1 March 2024", 1, "frontmatter"), ("Guide Version 6.1 March 2024", 4, "content"),
        ("It does not constitute a formal endorsement.", 5, "disclaimer"), ("Module Question Number Answer", 5, "exercise"), ("see ACTIVITY 1: QUIZ", 5, "content"), ("", None, "content"),
    ]
    got = L.classified(spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(rows)], "id int, text string, page int")).collect()
    assert {r["id"]: r["kind"] for r in got} == {i: k for i, (_, _, k) in enumerate(rows)}


def test_prefixes_letter_by_letter():
    """The pieces that grow by the letter that most have next are the common prefixes of those that share the first letter."""
    rng = random.Random(6)
    for _ in range(200):
        heads = ["".join(rng.choices("ab c", k=rng.randrange(4, 12))) for _ in range(2)]
        texts = [rng.choice(heads) + rng.choice(["1 ", " 22", ""]) + rng.choice(heads) + "".join(rng.choices("xyz", k=4)) for _ in range(12)]
        out, live = [], [(t, L._page_run(t, 0)) for t in texts]
        while live and len(out) < L.MOST_SEGMENTS:
            letters = [t[at] for t, at in live if at < len(t)]
            top = max(letters, key=letters.count, default=None)
            if top is None or letters.count(top) * 2 < len(texts):
                break
            live, n = [(t, at) for t, at in live if t[at : at + 1] == top], 0
            while len({t[at : at + n + 1] for t, at in live}) == 1 and all(at + n < len(t) for t, at in live):
                n += 1
            piece = live[0][0][live[0][1] : live[0][1] + n]
            if len(piece.strip()) < L.SHORTEST_SEGMENT:
                break
            out.append(piece.strip())
            live = [(t, L._page_run(t, at + n)) for t, at in live]
        assert L.segments(texts, len(texts)) == out


def test_running_affix():
    texts = [f"{k} VA Guide Spring {k} Real text number {k * 7} that differs. Version {'A' if k == 3 else 'B'} 2024 end" for k in range(1, 15)]
    prefix, suffix = L.running_affix(texts)
    assert prefix[0] == "VA Guide Spring" and suffix[-1].endswith("2024 end")
    assert "VA Guide" not in L.without_running(texts[5], prefix, suffix)
    assert L.running_affix(texts[:11]) == ([], []) and L.running_affix(["short"] * 20) == ([], [])
    assert L.without_running("Module 1Module 2Module 3 text...... 12", [], []) == "text" and L.without_running(" 12 ", [], []) == ""


def test_exercises_are_cut_from_their_heading(spark):
    cut = lambda t: one(spark, L.without_exercise(F.lit(t)))
    assert cut("Real advice. JOB QUIZ TRUE FALSE 1. x\ny") == "Real advice."
    assert cut("\u2022 item one \u2022 item HEAD QUIZ  TRUE FALSE z") == "\u2022 item one \u2022"
    assert cut("a quiz about true things") == "a quiz about true things" and len(cut("word " * 20_000)) == 99_999


def test_robots(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /x\n\nUser-agent: Quill\nAllow: /x/y\nDisallow: /x\nDisallow:"), ("b", "Disallow: /"), ("c", None)], "host string, robots string")
    paths = spark.createDataFrame([("a", "/x/y/1"), ("a", "/x/z"), ("a", "/"), ("b", "/q"), ("c", "/q"), ("a", None)], "host string, path string").withColumn("_row", F.lit(1))
    got = [(r["host"], r["path"], r["allowed"], r["_row"]) for r in G.path_allowed(paths, S.robots_rules(files, "quillbot/1")).collect()]
    assert sorted(got, key=repr) == sorted([("a", "/x/y/1", True, 1), ("a", "/x/z", False, 1), ("a", "/", True, 1), ("b", "/q", True, 1), ("c", "/q", True, 1), ("a", None, True, 1)], key=repr)


def test_word_lists_refuse(spark):
    import pytest

    words = spark.createDataFrame([("b",), ("a",), ("x-y",)], "word string")
    assert [r["word"] for r in R.curated(words, words.where("word = 'x-y'"), 2).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="letters"):
        R.curated(words, words.where("false"), 1)
    with pytest.raises(ValueError, match="too few"):
        R.curated(words, words.where("word = 'x-y'"), 3)


def test_empty_tables(spark):
    blocks = spark.createDataFrame([], "id long, ord long, text string, page int")
    assert L.cleaned(blocks).count() == 0 and L.rebuilt(L.cleaned(blocks)).count() == 0
    assert H.raw_blocks(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert S.acronyms_printed(spark.createDataFrame([], "text string")).count() == 0
    assert T.words  # the module stays importable without a session


def test_matches_by_arrays_are_those_of_the_automaton():
    """Letters that come apart and runs that overlap too; where the whole passage stands first it is taken as it is."""
    rng = random.Random(6)
    for k in range(600):
        signs = ("ab", "abc ", "abcdefgh 12 é ﬁ ß ⅷ")[k % 3]
        text, part = "".join(rng.choices(signs, k=rng.randrange(1, 300))), "".join(rng.choices(signs, k=rng.randrange(1, 80)))
        if k % 2:
            a = rng.randrange(len(text))
            part = text[a : a + 60].upper()
            text = text[: a + 30] + "zz" + text[a : a + 60] + text[a + 30 :]
        hay, (needle, known) = C.Letters.of(text), C._read(part)
        assert (hay.bytes.decode(), hay.at.tolist()) == C.folded(text)
        least = min(C.SMALLEST, len(needle.bytes))
        if least:
            assert C.matches(needle, known, hay, least) == C.Repeats(C.folded(part)[0]).matches(C.folded(text)[0], least)


def test_a_citation_takes_along_the_pages_around_it_alone():
    body = "The quick brown fox jumps over the lazy dog and then it sleeps for a while."
    pages = [f"page {n} has nothing of it" for n in range(40)]
    pages[21] = body[:40]
    pages[22] = body[40:]
    whole = C.located_in_pages(pages, 23, body.upper())
    assert [p for p, *_ in whole] == [22, 23] and C.located_in_pages(pages[21:25], 23, body.upper(), 22, 40) == whole


def test_lines_of_a_canonical_text(spark):
    text = " á   b\r\n\n\tofﬁce​ \n-\n x y\t \ńz"
    got = [x.strip(" ") for x in one(spark, T.canonical_lines(F.lit(text)))]
    assert got == [one(spark, T.canonical(F.lit(x))) for x in text.split("\n")]


def test_patterns_that_look_back_try_their_own_letters_alone():
    """Else each place of a text pays for the looking back."""
    assert C._SENTENCE.startswith("(?=[.!?])") and C.SHOWN[-1][0].startswith("(?=[yo])")


def test_each_citation_has_a_row(spark):
    """Those of unknown documents, pages that aren't there and passages that aren't found too; the others as one by one, however many
    share the pages of a document."""
    rng = random.Random(9)
    pages = {d: [" ".join(rng.choices(("Straße", "Önologie", "office", "one", "two", "three", "cité"), k=rng.randrange(0, 60))) for _ in range(rng.randrange(1, 40))] for d in range(6)}
    asked = [("none", 77, 1, "x"), ("null", 0, None, "x"), ("far", 1, 10**6, "x"), ("before", 1, -3, "x"), ("empty", 2, 1, None)]
    for k in range(700):
        d = rng.randrange(6) if k % 2 else 3
        n = rng.randrange(1, len(pages[d]) + 1)
        words = " ".join(pages[d][n - 1 : n + 1]).split(" ")
        a = rng.randrange(len(words))
        asked.append((f"k{k}", d, max(1, n - k % 3), " ".join(words[a : a + 30]).upper()))
    cited = spark.createDataFrame(asked, "key string, id int, page int, passage string")
    got = {}
    for r in C.highlights(cited, spark.createDataFrame(list(pages.items()), "id int, pages array<string>")).collect():
        got.setdefault(r["key"], []).append(tuple(r)[1:])
    want = {key: C.located_in_pages(pages.get(d, []), page, passage or "") for key, d, page, passage in asked}
    assert {k: sorted(v) for k, v in got.items()} == {k: v or [(None,) * 4] for k, v in want.items()}
    assert sum(bool(v) for v in want.values()) > 500


def test_passages_are_found_in_other_letters():
    """Capitals of ß are two letters: a passage in capitals stands where the one in its text does."""
    text = "In der großen Straße heißt es, daß Fuß und Maß bloß Spaß machen."
    assert C.located("vor " + text, text.upper()) == C.located("vor " + text, text) == (4, 4 + len(text) - 1, 1.0)


def test_no_passage_is_left_out(spark, tmp_path):
    """A page is cited that is there, pages without text count, and a line that ends with a hyphen doesn't leave out its document."""
    texts = ["Der Fuß-\nball ist groß.\nUnd das Maß auch.", "one two three four five six\n" * 7, "first\n\n\n\n\n\n\n\n\n\n\nA line far below that is longer than forty letters.", " \n​", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.highlights(spark, str(tmp_path)).collect()
    assert {r["key"].split(":")[0] for r in got} == {"0", "1", "2"} and all(r["page"] for r in got)
    assert {r["page"] for r in got if r["key"] == "2:0"} == {1, 3} and {r["key"] for r in got} == {f"{r['id']}:{r['nth']}" for r in C.passages(P._documents(spark, str(tmp_path)), 96).collect()}


def test_documents_stay_rows(spark, sf):
    """Blocks and sections by looking at all lines of a text, without a shuffle of lines."""
    from tests.test_spread import plan_of

    lines = {r["id"]: r["l"] for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), T.canonical_lines(F.col("text")).alias("l")).collect()}
    made = P._documents(spark, sf)
    for r in made.collect():
        head, want = None, []
        for k, x in enumerate(lines.pop(r["id"])):
            x = x.strip(" ")
            if x:
                head = x if len(x) < 40 else head
                want.append((k, x, head, k // 5 + 1))
        assert [tuple(b) for b in r["blocks"]] == want and r["text"] == " ".join(x for _, x, _, _ in want)
    assert not any(x.strip(" ") for got in lines.values() for x in got)
    plan = plan_of(P._documents(spark, sf))
    assert "hashpartitioning" not in plan and plan.count("ArrowEvalPython [nfc(") == 1
