import hashlib
import itertools
import random
import re
import time

import numpy as np

from quillspark.llm import pii


def brute(text):
    """The patterns as they are stated, by the regular expression engine alone."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(twice) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_spans_on_random_texts():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "@", ".", "x-y", "1", "22", "256", "255.", "1.2.3.4", "+", "+1 ", " ", "-", "_", "4111 1111 1111 1111", "4111111111111111", "(555)", "é", "\n", "%", "٣"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randrange(25)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_base_spans_of_the_table(odd, documents):
    for df in (odd, documents):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in pii.find_pii(df).collect():
            want = brute(texts[r["doc_id"]])
            named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
            assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == i for x in want) for i in range(4)]
            assert set(named.split(",")) <= set(r["spans"].split(","))


def documents_with_people(rng, n):
    out = []
    for _ in range(n):
        name = "".join(rng.choices("abcdefgh", k=6)) + f".{rng.randrange(10, 99)}"
        number = f"{rng.randrange(200, 999)} {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        out.append((f"Some words 12 here. Write to {name}@mail{rng.randrange(9)}.example.com or call +1 {number} before {rng.randrange(1990, 2030)}. Items: {rng.randrange(100)} and 3.5.", name, number))
    return out


def test_repeats_get_their_label(spark):
    rng = random.Random(2)
    people = documents_with_people(rng, 400)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(people)], "doc_id long, text string")
    field = pii.train(df)
    held_out = documents_with_people(rng, 200)
    found = clean = 0
    for text, name, _ in held_out:
        base = pii.base_spans(text)
        clean += not field.added(text, base)
        again = f"{text} Later {name} wrote again, on page 17 of 200."
        added = field.added(again, pii.base_spans(again))
        at = again.rindex(name)
        found += (0, at, at + len(name)) in added and len(added) == 1
    assert clean >= 198 and found >= 180


def test_field_runs_without_base_spans(spark):
    """Unmatched numbers, repeated or alone, get their labels in texts in which no pattern matches, too."""
    m = len(pii.LABELS)
    unary = np.zeros((pii.N_FEATURES, m))
    unary[0, 0], unary[5, 4] = 4.0, 8.0
    field = pii.Field(unary, np.zeros((m, m)), np.diag([1.0, *[6.0] * len(pii.KINDS)]))
    rows = [(1, "Ring 201-4477 now. I said 201-4477 twice."), (2, "Ring 201-4477 now. I said 201-4477 twice. Mail a.b@c.de too."), (3, "One number, 201-4477, alone."), (4, "No number at all.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df, field).collect()}
    assert got == {1: "phone:5:13,phone:26:34", 2: "email:47:55,phone:5:13,phone:26:34", 3: "phone:12:20", 4: ""}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df, field).collect()}[1] == "Ring [PHONE] now. I said [PHONE] twice."


def exact(field, g):
    """Marginals by adding up all labellings."""
    m, n = len(pii.LABELS), len(g.nodes)
    bits = (np.array(g.form)[:, None] >> np.arange(pii.N_FEATURES)) & 1
    own = bits @ field.unary
    own[:, 1:] = np.clip(own[:, 1:] - own[:, :1], -pii.FORM, pii.FORM)
    own[:, 0] = 0
    out = np.zeros((n, m))
    for labels in itertools.product(range(m), repeat=n):
        if any(s and s != y for s, y in zip(g.seen, labels, strict=True)):
            continue
        score = sum(own[i, y] for i, y in enumerate(labels) if not g.seen[i])
        score += sum(field.chain[labels[i], labels[j]] for i, j in g.chain) + sum(field.skip[labels[i], labels[j]] for i, j in g.skip)
        for i, y in enumerate(labels):
            out[i, y] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_beliefs_against_exact_marginals(monkeypatch):
    """Equal on trees; near on graphs with a loop."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(pii, "ROUNDS", 200)
    m = len(pii.LABELS)
    for text, most in (("a1 b2 c3 d4", 1e-2), ("name.11@x.yz wrote; name.11 asked for 22 and 33", 1e-2), ("5550123 one 5550123 two 5550123", 1e-2), ("71234567 81234567 and 91234567", 0.2)):
        for _ in range(5):
            skip = rng.normal(0, 0.7, (m, m))
            field = pii.Field(rng.normal(0, 1, (pii.N_FEATURES, m)), rng.normal(0, 0.7, (m, m)), skip + skip.T)
            g = pii.Graph(text, pii.base_spans(text))
            assert np.abs(field.beliefs(g) - exact(field, g)).max() < most


def test_similar_numbers_agree(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(documents_with_people(rng, 400))], "doc_id long, text string")
    field = pii.train(df)
    for text, start in (("call +1 415 555-0132; later 4155550132", 28), ("call +1 415 555-0132; later (555) 0132 or 415-555-0132", 42)):
        assert any(k == 3 and s >= start for k, s, _ in field.added(text, pii.base_spans(text))), text
    assert not field.added("call +1 415 555-0132 in 2019, or 2019 times; 4041", pii.base_spans("call +1 415 555-0132 in 2019, or 2019 times; 4041"))


def test_secrets():
    text = 'token = "11acdfb36bb72224148e6160f674b4be45601bff" and token of no worth; api_key: ABCDEF0123456789ABCDEF01'
    assert [text[s:e] for s, e in pii.secret_spans(text)] == ["11acdfb36bb72224148e6160f674b4be45601bff", "ABCDEF0123456789ABCDEF01"]
    assert pii.redacted(text, []) == 'token = "[SECRET]" and token of no worth; api_key: [SECRET]'
    assert pii.secret_spans("the token = abcdefghijklmnopqrstuvwxyz") == []


def test_trained_field_leaves_plain_numbers(spark):
    """Years, counts and prices, repeated or not, get no label in texts without personal data."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(documents_with_people(rng, 400))], "doc_id long, text string")
    field = pii.train(df)
    marked = 0
    for _ in range(200):
        year, count = rng.randrange(1900, 2030), rng.randrange(1000, 90_000)
        marked += bool(field.added(f"In {year} there were {count} items at 3.5 each. After {year} the {count} items went, {rng.randrange(100)} a day.", []))
    assert marked <= 2


def test_kinds_that_a_token_meets():
    rng = random.Random(7)
    for _ in range(300):
        spans = []
        for kind in range(4):
            at = 0
            for _ in range(rng.randrange(4)):
                start = at + rng.randrange(6)
                at = start + rng.randrange(1, 6)
                spans.append((kind, start, at))
        held = pii.Spans(spans)
        for _ in range(20):
            s = rng.randrange(30)
            e = s + rng.randrange(1, 8)
            assert sorted(held.met(s, e)) == sorted({k for k, a, b in spans if a < e and s < b})
    # a long token that many spans of one kind fill has its label
    text = ";".join("4111111111111111,1.2.3.4" for _ in range(50))
    assert set(pii.Graph(text, pii.base_spans(text)).seen) == {2}


def test_words_before_a_number_tell(spark):
    """Numbers of one form are labelled by the word before them."""
    assert pii.word_before("Please call: +1", 13) == "call" and pii.word_before("line\n 12", 6) == "" and pii.word_before("", 0) == ""
    rng = random.Random(5)
    number = lambda: f"{rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {rng.randrange(10, 99)}"
    rows = [(i, f"Call +{number()} today. Item {rng.randrange(1000000, 9999999)} is gone, lot {rng.randrange(1000000, 9999999)} too.") for i in range(500)]
    field = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    cue = pii.features("5551234", " ", "call") ^ pii.features("5551234", " ", "item")
    bit = cue.bit_length() - 1
    assert field.unary[bit, 4] - field.unary[bit, 0] > 0


def test_many_spans_are_linear():
    """Thousands of base spans and repeated numbers in one text."""
    unary = np.zeros((pii.N_FEATURES, len(pii.LABELS)))
    unary[5, 4] = 9.0
    field = pii.Field(unary, np.zeros((len(pii.LABELS),) * 2), np.diag([0.0, *[4.0] * len(pii.KINDS)]))
    took = []
    for n in (2000, 8000):
        text = " ".join(f"a{i}@b.cd 201-4477 10.0.{i % 256}.1" for i in range(n))
        base = pii.base_spans(text)
        start = time.perf_counter()
        assert len(field.added(text, base)) == n and len(base) == 2 * n
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.3


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 60_000, "1." * 60_000, "+1" * 60_000, "1 " * 60_000):
        pii.base_spans(text)
    text = "4111 1111 1111 1111 " + "7 " * 20_000
    pii.Graph(text, pii.base_spans(text))


def test_redaction(spark, odd, none):
    text = "Mail a.b@c.de, or +1 (555) 555-0199."
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "clean", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["text"], r["lang"]) for r in pii.redact(df).collect()}
    assert got == {1: ("Mail [EMAIL], or [PHONE].", "x"), 2: (None, "y"), 3: ("clean", None)}
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    assert pii.redact(none).count() == 0 and pii.find_pii(none).count() == 0
