import re
from itertools import permutations

from quillspark.llm import filter_audit, queries

from .oracle import same


def plain(rows, labels):
    """All orders filter by filter, row by row."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    fails, out = [], {}
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        marks = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), earlier)
        fails.append((i, part or "", {f for f, m in zip("ABCDE", marks) if m}))
    for part in {p for _, p, _ in fails}:
        mine, removed = [(i, f) for i, p, f in fails if p == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for k, f in enumerate(order):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                removed[f] = removed.get(f, 0) + len(gone)
                redundant = sum(f in x for _, x in mine) - len(gone)
                out[part, order, k + 1] = (len(left), len(gone), redundant, sum(x == {f} for _, x in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1] += (removed[f],)
    return out


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def check(spark, rows, labels):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NAMES) for r in filter_audit.audit(df, marks).collect()}
    assert got == plain(rows, labels)


def test_against_plain_orders(spark, documents):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i, _, _ in rows if i % 5]
    check(spark, rows, labels)


def test_nulls_copies_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [
        (5, long, "en"), (3, long, None), (3, long, ""), (9, long, "en"), (None, long, "en"), (None, None, "en"), (1, None, "de"), (2, "", "de"), (2, "", "de"), (2, "", "fr"),
        (7, "WORDS " * 200, "en"), (8, long + " #", "en"), (8, long + " #", "en"), (10, "\u00c4\u00d6" * 50, "en"), (11, "A" + "b" * 9, "en"), (12, "a\u00a0b " * 100, "en"), (13, "x" * 300_000 + " y" * 100_000, "en"),
    ]
    labels = [(5, 1, None), (5, 0, 1), (3, None, 1), (2, 1, 0), (None, 1, 1), (99, 1, 1), (9, 0, 0), (8, 1, 1)]
    check(spark, rows, labels)


def test_large_groups_of_copies(spark):
    """Copies in thousands, over parts: all but the least id fail."""
    rows = [(i, "the same", "ab"[i % 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16)
    got = filter_audit.audit(df, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int"))
    first = {r["part"]: r["removed"] for r in got.where("filter_order = 'EABCD' AND step = 1").collect()}
    assert first == {"a": 1999, "b": 2000}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    assert filter_audit.audit(odd, labels).count() == 600 * odd.selectExpr("coalesce(lang, '')").distinct().count()
    assert filter_audit.audit(odd, labels.where("false")).count() > 0


def test_against_sql(spark, sf):
    assert same(spark, queries.op11_filter_audit, filter_audit.ORACLE, sf)
    assert same(spark, queries.op11_filter_audit, filter_audit.ORACLE, "/root/testdata/sf0.01")
