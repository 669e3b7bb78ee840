import random
import re

from quillspark.llm import license_scan as ls


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(s, y) for p, y in ls.PHRASES for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
    return len(words), places


TEXTS = [
    "Under the MIT License. under the mit license under the mit license",
    "x Apache License, Version 2.0 and CC-BY-NC, cc by nc nd",
    "This work is licensed under the GNU General Public License, version 3.",
    "under the under the mit license",
    ls.TEMPLATES[0][1].replace("without restriction", "without any restriction"),
]


def test_against_brute_force(spark, odd, documents):
    rng = random.Random(1)
    vocabulary = "under the mit license apache version 2 cc by nc é x".split()
    texts = TEXTS + [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(200)]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (made, odd.select("doc_id", "text"), documents):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in ls.license_scan(df).collect():
            n, places = brute(texts[r["doc_id"]])
            starts = [s for s, _ in places]
            base = sorted({y for _, y in places})
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base))
            labels = r["labels"].split(",") if r["labels"] else []
            assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= r["score"] <= 1


def test_templates_give_their_labels_alone():
    scanner = ls.Scanner()
    for label, text in ls.TEMPLATES:
        _, _, spans = scanner.scan(f"some words {text} other words".encode())
        assert label in {y for _, _, y, c in spans if c >= scanner.min_cover}
    gpl = {y for _, _, y, c in scanner.scan(TEXTS[2].encode())[2] if c >= scanner.min_cover}
    assert gpl == {"gpl-3"}
    changed = {y for _, _, y, c in scanner.scan(TEXTS[4].encode())[2] if c >= scanner.min_cover}
    assert changed == {"mit"}


def test_matching_statistics():
    scanner = ls.Scanner(phrases=(("a b c", "p"),), templates=(("t", "a b d e f"), ("u", "d e g")), min_run=3)
    rng = random.Random(2)
    sequences = ["a b c".split(), "a b d e f".split(), "d e g".split()]
    for _ in range(200):
        words = rng.choices(list("abcdefgz"), k=30)
        _, runs = scanner.statistics([w.encode() for w in words])
        longest = {}
        for end in range(len(words) + 1):
            for n in range(end + 1):
                if any(words[end - n : end] == s[i : i + n] for s in sequences for i in range(len(s) - n + 1)):
                    longest[end] = n
        want = [(e, n) for e, n in longest.items() if n >= 3 and longest.get(e + 1, 0) != n + 1]
        assert [(e, n) for e, n, _ in runs] == want


def test_empty_table(none):
    assert ls.license_scan(none).count() == 0


def test_all_notices_of_a_text_are_spans():
    scanner = ls.Scanner()
    notice = dict(ls.TEMPLATES[::-1])["mit"]
    text = " filler words here ".join([notice, "x", notice, "Licensed under CC BY-SA 4.0", notice])
    spans = scanner.scan(text.encode())[2]
    assert [y for _, _, y, _ in spans] == ["mit", "mit", "cc-by-sa", "mit"]
    many = scanner.scan((" one two three four five ".join([notice] * 300)).encode())[2]
    assert len(many) == 300 and all(a < b for a, b, _, _ in many)


def test_perturbed_notices():
    """A tenth of the words other or missing: the label stays, and no other comes."""
    rng, scanner = random.Random(3), ls.Scanner()
    right = total = 0
    for label, text in ls.TEMPLATES:
        words = text.split()
        if len(words) < 20:
            continue
        for _ in range(40):
            new = [w if (r := rng.random()) > 0.1 else f"zz{rng.randrange(99)}" if r > 0.05 else "" for w in words]
            got = {y for _, _, y, _ in scanner.scan(("before " + " ".join(new) + " after").encode())[2]}
            right += got == {label}
            total += 1
    assert right >= 0.95 * total


def test_close_templates_and_versions():
    scanner = ls.Scanner()
    label = lambda t: {y for _, _, y, _ in scanner.scan(t.encode())[2]}
    assert label("it is licensed under the apache license 2.0 here") == {"apache-2"}
    assert label("this work is licensed under a creative commons attribution noncommercial 4.0 international license") == {"cc-by-nc"}
    assert label("this work is licensed under the gnu general public license version 2") == {"gpl-2"}
    assert label("Licensed under CC BY-ND 4.0") == set()
