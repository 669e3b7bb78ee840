import random
from collections import defaultdict

import numpy as np

from quillspark.llm import paragraph_dedup as pd


def words(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def test_bands_reach_the_recall():
    bands, rows = pd.tuned_bands()
    assert 1 - (1 - pd.THRESHOLD**rows) ** bands >= pd.RECALL
    assert 1 - (1 - pd.THRESHOLD**rows) ** (bands - 1) < pd.RECALL


def test_windows_of_a_copied_passage_agree():
    """Two texts share a window wherever a passage of SPAN + GAP - 1 words stands in them."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        passage = rng.integers(0, 2**63, pd.SPAN + pd.GAP - 1).astype(np.uint64)
        keys = []
        for _ in range(2):
            text = np.concatenate([rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64), passage, rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64)])
            keys.append({text[p : p + pd.SPAN].tobytes() for p in pd.places(text).tolist()})
        assert keys[0] & keys[1]


def test_planted_cases(spark):
    """Passages of 50 words inside lines and near-equal lines are found, in all but their first document; clean ones aren't."""
    rng = random.Random(2)
    docs, planted, near, clean = [], defaultdict(list), defaultdict(list), []
    passages = [words(rng, 50) for _ in range(20)]
    lines = [words(rng, 60) for _ in range(20)]
    for i in range(300):
        text = [words(rng, rng.randrange(30, 80)) for _ in range(3)]
        kind = i % 3
        if kind == 0:
            p = rng.randrange(20)
            at = rng.randrange(len(text[1]))
            text[1][at:at] = passages[p]
            planted[p].append(i)
        elif kind == 1:
            p = rng.randrange(20)
            line = list(lines[p])
            if near[p]:  # the first is unchanged: the others' similarity with it is over 0.8
                line[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            text.insert(rng.randrange(3), line)
            near[p].append(i)
        else:
            clean.append(i)
        docs.append((i, "\n".join(" ".join(x) for x in text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = pd.find_repeats(df).collect()
    flagged, removed = {r["doc_id"] for r in got}, {r["doc_id"] for r in got if r["removed"]}
    assert not flagged & set(clean)
    for group in planted.values():
        if len(group) > 1:
            assert set(group) <= flagged and removed & set(group) == set(group) - {min(group)}
    hit = sum(len(set(g) & flagged) for g in near.values() if len(g) > 1)
    assert hit >= 0.97 * sum(len(g) for g in near.values() if len(g) > 1)
    after = {r["doc_id"]: r["text"] for r in pd.drop_repeats(df).collect()}
    texts = dict(docs)
    for i, t in texts.items():
        assert after[i] == t if i not in removed else len(after[i].split()) == len(t.split()) - sum(r["n_words"] for r in got if r["removed"] and r["doc_id"] == i)


def test_runs_reach_the_ends_of_the_passage(spark):
    """All words of a copied passage, and no others, are in its run; of a shorter first copy what it has is removed."""
    rng = random.Random(7)
    docs, spots = [], defaultdict(list)
    for p in range(40):
        passage = words(rng, 50 + rng.randrange(31))
        for copy in range(3):
            part = passage[:49] if copy == 0 and p % 2 else passage
            before, after = words(rng, rng.randrange(40)), words(rng, rng.randrange(40))
            spots[p].append((len(docs), len(before), len(before) + len(part)))
            docs.append((len(docs), " ".join(before + part + after)))
    got = {(i, flag): set() for i, _ in docs for flag in (True, False)}
    for r in pd.find_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r["doc_id"], r["removed"]] |= set(range(r["start_word"], r["end_word"]))
    for p, (one, two, three) in spots.items():
        shared = 49 if p % 2 else two[2] - two[1]
        assert got[one[0], False] == set(range(*one[1:])) and not got[one[0], True]
        assert got[two[0], True] == set(range(two[1], two[1] + shared))
        assert got[two[0], True] | got[two[0], False] == set(range(*two[1:]))
        assert got[three[0], True] == set(range(*three[1:]))


def test_large_family_of_near_lines(spark, monkeypatch):
    """Lines of one changed word each are similar to the original (61 of 71 shingles) alone, or to those changed near by."""
    monkeypatch.setattr(pd, "places", lambda words: np.zeros(0, np.int64))
    rng = random.Random(5)
    line, other = words(rng, 60), words(rng, 60)
    docs = [(0, " ".join(line))]
    for i in range(1, 1001):
        changed = list(line)
        changed[5 + i % 50] = f"y{i}"
        docs.append((i, " ".join(changed)))
    docs.append((1001, " ".join(other)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = pd.find_repeats(df).collect()
    assert {r["doc_id"] for r in got} == set(range(1001)) and len({r["class_id"] for r in got}) == 1
    assert [r["doc_id"] for r in got if not r["removed"]] == [0]


def test_lines_of_random_families_against_all_pairs(spark, monkeypatch):
    """Clusters are the components of all pairs of lines that are similar."""
    monkeypatch.setattr(pd, "places", lambda words: np.zeros(0, np.int64))
    rng = random.Random(6)
    docs = []
    for _ in range(12):
        line = words(rng, rng.randrange(25, 70))
        for _ in range(rng.randrange(1, 30)):
            new = list(line)
            for _ in range(rng.randrange(4)):
                new[rng.randrange(len(new))] = f"z{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(new)))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in docs]
    head = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) and head[i] != head[j]:
                old, new = max(head[i], head[j]), min(head[i], head[j])
                head = [new if h == old else h for h in head]
    want = {frozenset(i for i, h in enumerate(head) if h == g) for g in head}
    got = defaultdict(set)
    for r in pd.find_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == {g for g in want if len(g) > 1}


def test_near_passages_inside_long_lines(spark):
    """Passages of sixty words with one word changed, inside lines of some two hundred, against what holds of all pairs by plan."""
    rng = random.Random(9)
    docs, spots = [], []
    for p in range(100):
        passage = words(rng, 60)
        for copy in range(2):
            own = list(passage)
            if copy:
                own[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            before, after = words(rng, 40 + rng.randrange(60)), words(rng, 40 + rng.randrange(60))
            spots.append((len(docs), len(before)))
            docs.append((len(docs), " ".join(before + own + after)))
    docs += [(1000 + k, " ".join(words(rng, 200))) for k in range(50)]
    got = defaultdict(set)
    for r in pd.find_repeats(spark.createDataFrame(docs, "doc_id long, text string")).where("removed").collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    found = [len(got[i] & set(range(at, at + 60))) for i, at in spots if i % 2]
    assert sum(n >= 50 for n in found) >= 90
    assert all(len(got[i]) <= 60 for i, _ in docs) and not any(got[i] for i, _ in docs if i % 2 == 0)


def test_extension():
    a = np.arange(60, dtype=np.uint32)
    b = a.copy()
    b[10] = 999
    assert pd.extension(a.tobytes(), b.tobytes()) == 60 and pd.extension(b[8:14].tobytes(), a[8:14].tobytes()) == 2
    assert pd.extension(b"", a.tobytes()) == 0 and pd.extension(a[1:].tobytes(), a.tobytes()) == 0


def test_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text, 1, 2, 3), (2, text + " more", 4, 5, 6), (None, text, 7, 8, 9)], "doc_id long, text string, _id long, runs long, row long")
    out = pd.drop_repeats(df)
    assert out.columns == df.columns
    assert {(r["doc_id"], r["text"], r["_id"]) for r in out.collect()} == {(1, text, 1), (2, "", 4), (None, text, 7)}  # the second line is near the first


def test_places_read_back(spark, documents):
    """What is said to be a repeat of exact windows stands in another place of the table."""
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in documents.collect()}
    spots = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - pd.SPAN + 1):
            spots[tuple(w[k : k + pd.SPAN])].add(i)
    again = {i for s in spots.values() if len(s) > 1 for i in s}
    long_again = set()
    spots = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            spots[tuple(w[k : k + 50])].add(i)
    for s in spots.values():
        if len(s) > 1:
            long_again |= s
    got = pd.find_repeats(documents).collect()
    for r in got:
        assert 0 <= r["start_word"] < r["end_word"] <= len(texts[r["doc_id"]])
    assert long_again <= {r["doc_id"] for r in got}
    assert again


def test_odd_rows(spark, odd, none):
    assert pd.find_repeats(none).count() == 0 and pd.drop_repeats(none).count() == 0
    rows = [(None, "word " * 40), (1, "a " * 40), (1, "a " * 40), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in pd.find_repeats(df).where("removed").collect()} <= {1}
    assert pd.drop_repeats(odd).columns == odd.columns and pd.drop_repeats(odd).count() == odd.count()
    assert pd.cut(b"a b c d", [(1, 3)]) == b"a d" and pd.cut(b" a b\nc", [(0, 2)]) == b" c" and pd.cut(b"a b", [(1, 2)]) == b"a "


def test_a_common_passage_is_in_no_prefix(spark):
    """Tokens of all values are counted, so what many lines share comes last."""
    rng = random.Random(9)
    passage = words(rng, 40)
    rows = [(d, " ".join(passage + words(rng, 40)).encode()) for d in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, text binary")
    common = set(pd.Shingler()(" ".join(passage).encode()).tolist())
    got = [set(np.frombuffer(r["prefix"], np.uint64).tolist()) for r in pd.lines(texts, pd.frequent_order(texts)).collect()]
    assert len(got) == 40 and not any(common & x for x in got)
