"""Answers, their measures and gates, and which texts contain which snippets, against plain loops."""

import math
import random
import re

from pyspark.sql import functions as F

from quillspark.operators import answers as A
from quillspark.operators import chunking as C
from quillspark.operators import sources as S
from quillspark.operators.containment import containing


def fold(t):
    return re.sub(r"\s+", " ", re.sub("[^a-z0-9 ]+", " ", t.lower())).strip()


def without_echo(text, section):
    rest = text[len(section or "") :]
    if section and text.startswith(section) and not re.match("[A-Za-z0-9]", rest) and not re.match(r"(?i)(?:if|unless)\b", section):
        return re.sub(r"^[\s:.\-]+", "", rest)
    return text


def plain(questions, accepted, cards, lead, select):
    """The measures query by query, as one walks through the cards."""
    out = {}
    for q, source, snippet in questions:
        if not source or not snippet:
            continue
        known = [(s, fold(x)) for s, x in [(source, snippet), *[(s, x) for k, s, x in accepted if k == q]] if s and x and fold(x)]
        holds = lambda text, s, known=known: any(a == s and n in fold(text) for a, n in known)
        mine = sorted((c for c in cards if c[0] == q), key=lambda c: c[1])
        row = dict.fromkeys(("answered", "expanded", "baseline", "head_same", "head_lead", "in_top", "best_card", "buried"), False) | {"length": None}
        if mine:
            _, _, s, section, excerpt = mine[0]
            passage = without_echo(excerpt, section)
            text = select(passage)
            n = row["length"] = len(text.split())
            head = lambda t, n: " ".join(re.split(r"\s+", t)[:n])
            row |= {"answered": holds(text, s), "expanded": holds(passage, s), "baseline": holds(head(excerpt, lead), s), "head_same": holds(head(passage, n), s), "head_lead": holds(head(excerpt, n), s)}
            at = [k for k, c in enumerate(mine) if holds(c[4], c[2])]
            row["in_top"], row["buried"] = bool(at), bool(at) and at[0] > 0 and not row["answered"]
            row["best_card"] = any(holds(select(without_echo(mine[k][4], mine[k][3])), mine[k][2]) for k in at)
        out[q] = row
    return out


def made_up(rng):
    words = ["Alpha", "beta,", "gamma.", "Delta", "if", "5%", "x-y", "Head."]
    text = lambda n: " ".join(rng.choices(words, k=n))
    cards = [(q, r, rng.choice("st"), rng.choice([None, "", "Alpha", "If so", "Head"]), rng.choice(["", "Alpha: ", "Head "]) + text(rng.randrange(1, 60))) for q in range(40) for r in range(1, rng.randrange(1, 5))]
    questions = [(q, rng.choice(["s", "t", "", None, "s"]), rng.choice([None, "", "...", text(2), text(3), text(1)])) for q in range(45)]
    accepted = [(rng.randrange(45), rng.choice(["s", "t", None]), rng.choice([text(1), text(2), None, "-"])) for _ in range(30)]
    return questions, accepted, cards


def test_measures_against_plain_loops(spark):
    rng = random.Random(1)
    questions, accepted, cards = made_up(rng)
    q = spark.createDataFrame(questions, "query int, source string, snippet string")
    a = spark.createDataFrame(accepted, "query int, source string, snippet string")
    c = spark.createDataFrame(cards, "query int, rank int, source string, section string, excerpt string")
    for lead, select, made in ((9, lambda t: A.first_words(t, 4), lambda t: " ".join(re.split(r"\s+", t)[:4])), (30, lambda t: C.openings(t), C.opening)):
        rows = A.answer_rows(q, a, c, lead, select)
        want = plain(questions, accepted, cards, lead, made)
        assert {r["query"]: {k: v for k, v in r.asDict().items() if k != "query"} for r in rows.collect()} == want
        m = A.answer_measures(rows, lead).first().asDict()
        lengths = sorted(r["length"] for r in want.values() if r["length"] is not None)
        assert m["n"] == len(want) and m["rendered"] == len(lengths) and m["longest"] == lengths[-1] and m["over_card"] == sum(x > lead for x in lengths)
        assert (m["median"], m["p90"]) == (lengths[int(len(lengths) * 0.5)], lengths[int(len(lengths) * 0.9)])
        assert all(m[k] == sum(r[k] for r in want.values()) for k in A.COUNTS)
        for p, (x, y) in A.PAIRS.items():
            b, d = sum(r[x] and not r[y] for r in want.values()), sum(r[y] and not r[x] for r in want.values())
            tail = sum(math.comb(b + d, i) for i in range(max(b, d), b + d + 1)) / 2 ** (b + d)
            assert (m[f"{p}_gained"], m[f"{p}_lost"]) == (b, d) and abs(m[f"{p}_p"] - min(1, 2 * tail)) < 1e-9


def test_no_questions_and_no_cards(spark):
    q = spark.createDataFrame([(1, "s", "x")], "query int, source string, snippet string")
    c = spark.createDataFrame([], "query int, rank int, source string, section string, excerpt string")
    pick = lambda t: A.first_words(t, 4)
    assert A.answer_measures(A.answer_rows(q, q.where("false"), c, 9, pick)).first().asDict().items() >= {"n": 1, "rendered": 0, "median": 0, "longest": 0, "in_top": 0}.items()
    none = A.answer_measures(A.answer_rows(q.where("false"), q.where("false"), c, 9, pick))
    assert none.first()["n"] == 0
    assert [r["failure"] for r in A.gate_failures(none, {"answered": 0.5}).collect()] == ["tier1_head: direction"]


def test_gate(spark):
    m = spark.createDataFrame([(10, 5, 6, 3, 2, 9, 1, 0, 10)], "n long, answered long, expanded long, tier1_head_gained long, tier1_head_lost long, experience_card_gained long, experience_card_lost long, over_card long, rendered long")
    got = lambda *a, **k: [(r["nth"], r["failure"]) for r in A.gate_failures(m, *a, **k).orderBy("nth").collect()]
    assert got({"answered": 0.5, "rendered": 1.0}) == []
    assert got({"answered": 0.55, "expanded": 0.6}, dirty=2) == [(1, "answered: 50.0% is below the floor of 55.0%"), (4, "2 passages carry junk in the selected answer")]
    assert got({}, bars={"tier1_head": True, "experience_card": True}) == [(0, "tier1_head: significance")]


def test_extractive_and_junk(spark):
    c = spark.createDataFrame([(1, 2, "t", None, "other"), (1, 1, "s", "Head", "Head: One two. Three.")], "query int, rank int, source string, section string, excerpt string")
    (e,) = A.extractive(c).collect()
    assert (e["text"], e["passage"], e["source"]) == ("One two. Three.", "One two. Three.", "s")
    p = spark.createDataFrame([(1, "If so", "You can."), (2, None, "QUIZ TRUE FALSE now"), (3, None, "Clean text."), (4, "Related articles", "Related articles"), (5, None, None)], "id int, section string, text string")
    got = {(r["id"], r["label"]) for r in A.junk(p).collect()}
    assert (1, "property condition-attached") in got and (2, "property no-graded-exercise") in got and not any(i in (3, 5) for i, _ in got)


def test_cited_answers(spark):
    retrieved = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f"https://{i}").alias("url"), F.lit("t").alias("title")) for i in ("a:1", "b:2")])
    said = F.lit("See [a:1]. Go to http://evil.example/x or www.b.c, call 855-260-3274, @scam_er [NATO]. AI–generated — verify against the official sources")
    (r,) = spark.range(1).select(A.cited_answer(said, F.array(F.lit("a:1"), F.lit("zz")), retrieved, F.array(F.lit("NATO"))).alias("x")).collect()
    x = r["x"]
    assert x["text"] == "See. Go to http://evil.example/x or www.b.c, call 855-260-3274, @scam_er [NATO]." and [c["id"] for c in x["citations"]] == ["a:1"]
    assert x["inert"] == ["http://evil.example/x", "www.b.c", "855-260-3274", "@scam_er"] and x["disclaimer"] == A.DISCLAIMER
    (r,) = spark.range(1).select(A.cited_answer(F.lit("AI-generated - verify against the official sources. And more"), F.array().cast("array<string>"), retrieved).alias("x")).collect()
    assert r["x"]["text"].endswith("And more") and r["x"]["citations"] == [] and r["x"]["inert"] == []


def test_containing_against_all_pairs(spark):
    rng = random.Random(2)
    texts = [(i, rng.choice(["s", "t", None]), None if i % 17 == 0 else "".join(rng.choices("ab c", k=rng.randrange(0, 30)))) for i in range(200)]
    snippets = [(k, rng.choice(["s", "t", "u", None]), rng.choice([None, "", "".join(rng.choices("ab c", k=rng.randrange(1, 6)))])) for k in range(150)]
    want = {(k, i) for k, s, x in snippets for i, u, t in texts if s is not None and s == u and x is not None and t is not None and x in t}
    t, q = spark.createDataFrame(texts, "id int, source string, text string"), spark.createDataFrame(snippets, "key int, source string, snippet string")
    for size in (1 << 20, 400):
        got = [(r["key"], r["id"]) for r in containing(t, q, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert containing(t, q.where("false")).count() == 0 and containing(t.where("false"), q).count() == 0


def test_selection_given_the_passage(spark):
    p = spark.createDataFrame([(1, 5, "s", None, "A first. The needle, is here. And more."), (2, 3, "s", None, "THE NEEDLE is here too"), (3, 1, "t", None, "the needle is here")], "id int, ord int, source string, section string, text string")
    q = spark.createDataFrame([(7, "s", "the needle is here"), (8, "t", "needle is"), (9, "u", "needle"), (10, "s", None)], "query int, source string, snippet string")
    assert {(r["query"], r["id"], r["hit"]) for r in A.selection_given_passage(q, p).collect()} == {(7, 2, True), (8, 3, True)}
    assert {(r["query"], r["hit"]) for r in A.selection_given_passage(q, p, lambda t: A.first_words(t, 1)).collect()} == {(7, False), (8, False)}


def test_expected_ids_fold_quotes(spark):
    p = spark.createDataFrame([(1, "s", "it’s  here"), (2, "s", "no")], "id int, source string, text string")
    assert [tuple(r) for r in S.expected_ids(spark.createDataFrame([(9, "s", "it's here")], "query int, source string, snippet string"), p).collect()] == [(9, 1)]


def test_snippets_of_any_length_are_found_in_one_pass(spark):
    """Of letters of one to four bytes, at a text's ends and over and over, copies too; the driver sees numbers, not snippets."""
    from quillspark.operators import containment as N

    rng = random.Random(3)
    signs = "ab é€\U0001f600"
    texts = [(i, "st"[i % 2], "".join(rng.choices(signs[: 2 + i % 5], k=rng.randrange(0, 120)))) for i in range(120)] + [(500, "s", "a" * 300), (501, "t", "a" * 300)]
    snippets = [(0, "s", "a" * 299), (1, "s", "a" * 301), (2, "t", "a")]
    for k in range(3, 200):
        _, source, text = rng.choice(texts)
        a = rng.randrange(len(text) + 1)
        piece = text[a : a + rng.choice((1, 2, 3, 7, 8, 15, 16, 17, 40))]
        snippets.append((k, rng.choice((source, "t")), piece if k % 4 else piece + "b"))
    want = {(k, i) for k, s, x in snippets for i, u, t in texts if s == u and x in t}
    t, q = spark.createDataFrame(texts, "id int, source string, text string").repartition(3), spark.createDataFrame(snippets, "key int, source string, snippet string")
    got = [(r["key"], r["id"]) for r in containing(t, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert N.BLOCK_BYTES // N.NUMBERS >= 1_000_000


def test_expected_ids_fold_texts_once(spark, sf):
    """No condition makes the folded texts before documents are dealt out, once more."""
    from quillspark.plans import catalog
    from tests.test_spread import plan_of

    plan = plan_of(catalog.QUERIES["sources_expected"](spark, sf))
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython [nfc(") == 1
