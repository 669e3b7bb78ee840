import random
from collections import defaultdict

import numpy as np

from quillspark.llm import ngram_join as nj
from quillspark.llm import queries
from quillspark.llm.common import components

from .oracle import same


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Compares all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def result(df):
    return sorted(tuple(r) for r in nj.joined(df).collect() if r["doc_id"] is not None)


def family(rng, n, words=70):
    """Variants of one text, from near to far, and texts that share a passage."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(7)):
            text[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out + [" ".join([*base[:20], *(f"y{rng.randrange(10**6)}" for _ in range(60))]) for _ in range(n // 4)]


def test_against_brute_force(spark, odd, documents):
    rng = random.Random(4)
    texts = [t for _ in range(6) for t in family(rng, 40)] + ["a b c d e", "A b C d E", "a b", "b a", "A B"]
    made = spark.createDataFrame([(i * 3 % 1009, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (made, odd.select("doc_id", "text").distinct(), documents):
        assert result(df) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_exact_without_buckets_and_with_small_groups(spark, monkeypatch):
    """The matrix alone finds every link: no pair comes from step 1, and groups and blocks are cut small."""
    rng = random.Random(5)
    made = spark.createDataFrame([(i, t) for i, t in enumerate(family(rng, 60) + family(rng, 30))], "doc_id long, text string")
    monkeypatch.setattr(nj, "bucket_pairs", lambda met: met.select(nj.F.col("rep").alias("a"), nj.F.col("rep").alias("b")).where("false"))
    monkeypatch.setattr(nj, "CAP", 4)
    monkeypatch.setattr(nj, "QUERIES", 3)
    assert result(made) == brute([(r["doc_id"], r["text"]) for r in made.collect()])


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 10**9, n).astype(np.uint64))
        keep = a[rng.random(len(a)) < 0.93]
        b = np.unique(np.concatenate([keep, rng.integers(0, 10**9, int(rng.integers(0, 4))).astype(np.uint64)]))
        if len(b) and nj.similar(a, b):
            k = 1 + min(len(a), len(b)) // nj.SHARE
            cut = lambda x: x[: min(nj.prefix_length(len(x)), len(x) - -(-3 * (len(a) + len(b)) // 7) + k)]  # noqa: E731, B023
            assert len(set(cut(a).tolist()) & set(cut(b).tolist())) >= k


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1200)] + [(i, i + 1) for i in range(5000, 5300)] + [(9000, i) for i in range(9001, 9400)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for start in sorted(near):
        stack = [start] if start not in seen else []
        seen.update(stack)
        while stack:
            x = stack.pop()
            want[x] = start
            new = near[x] - seen
            seen |= new
            stack += new
    assert got == want


def test_nulls_repeats_and_empty(spark, odd, none):
    assert nj.joined(none).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, None), (6, None), (7, " "), (8, " ")]
    got = sorted((tuple(r) for r in nj.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, None), (2, 2, 2), (2, 2, 2), (3, 2, 2), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8)], key=repr)
    assert nj.joined(odd).count() == odd.count()


def test_against_sql(spark, sf):
    assert same(spark, queries.op9_ngram_join, queries.ORACLES["op9_ngram_join"], sf)


def test_keep_one_with_clashing_names_and_repeated_ids(spark):
    text = "a b c d e f g h"
    rows = [(1, text, 1, 1), (2, text, 2, 2), (2, "other words under one id stand here", 3, 3), (4, "k l m n o p q", 4, 4), (4, "k l m n o p q", 3, 4), (None, text, 5, 5), (6, None, 6, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, row long")
    out = nj.keep_one(df)
    assert out.columns == df.columns
    # both rows of 2 go with their document; of the equal rows of 4 the lesser stays
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], rows[4], rows[5], rows[6]], key=repr)


def test_tokens_are_counted_in_all_texts(spark):
    rows = [(k, f"one two three four five six seven eight nine ten {k}".encode()) for k in range(3)]
    texts = spark.createDataFrame(rows, "doc_id long, text binary")
    shared = nj.Shingler()(b"one two three four five six seven eight nine ten")
    assert set(nj.heavy_tokens(texts, 1_000_000).tolist()) == set(shared[shared < 1 << 63].tolist())


def test_frequent_tokens_of_all_values_come_last(spark):
    """A passage that many texts share isn't in their prefixes, whatever the values of its tokens."""
    passage = [f"p{k}" for k in range(60)]
    rows = [(d, " ".join([*passage, *(f"w{d}x{k}" for k in range(60))]).encode()) for d in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, text binary")
    common = nj.Shingler()(" ".join(passage).encode())
    assert (common >= 1 << 63).any()
    keys = nj.frequent_keys(texts)
    assert set(keys.tolist()) == set((common >> nj.LOW_BITS).tolist())
    packed = nj.prefixes(texts, keys).collect()
    got = np.concatenate([np.frombuffer(r["token"], np.uint64) for r in packed])
    assert len(got) == 40 * nj.prefix_length(116) and not set(got.tolist()) & set(common.tolist())
    assert nj.in_company(nj.prefixes(texts, keys)).count() == 0


def test_shared_tokens_in_pieces(spark, monkeypatch):
    """Tokens of a part are told as shared also if their rows come in different pieces."""
    rng = random.Random(8)
    rows = [(d, [rng.randrange(300) for _ in range(20)]) for d in range(200)] + [(7, [301, 302]), (7, [301, 302])]
    made = [nj.packed_prefixes([np.array(sorted(set(t)), np.uint64)], np.array([d]), np.array([len(set(t))])) for d, t in rows]
    names = ["part", *nj.ROW]
    df = spark.createDataFrame([tuple(m[c][0].as_py() for c in names) for m in made], "part int, " + ", ".join(f"{c} binary" for c in nj.ROW))
    monkeypatch.setattr(nj.in_parts, "__defaults__", (50,))
    held = defaultdict(set)
    for d, t in rows:
        for x in t:
            held[x].add(d)
    want = sorted((x, d) for d, t in rows for x in set(t) if len(held[x]) > 1)
    assert sorted((r["token"], r["rep"]) for r in nj.in_company(df).collect()) == want
