import re
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import mixing


def water(sizes, weights, share, most):
    """Shares out by weight again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        above = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not above:
            return out | {s: left * w[s] / total for s in open_}
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def test_against_brute_force(odd, documents):
    for df in (odd, documents):
        rows = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in df.collect()]
        sizes = defaultdict(int)
        for _, s, n in rows:
            sizes[s] += n
        want = water(sizes, (3, 1, 2), 1.5, 2.0)
        got = mixing.mix_sources(df).collect()
        assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, n) for i, _, n in rows)
        taken, largest = defaultdict(int), defaultdict(int)
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert r["taken"] == r["copies"] * r["size"] and r["copies"] in (0, 1, 2)
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        for s in sizes:
            assert abs(taken[s] - want[s]) <= largest[s]


def test_reruns_and_partitions_agree(documents):
    rows = lambda df: sorted((r["doc_id"], r["copies"]) for r in mixing.mix_sources(df).collect())
    assert rows(documents) == rows(documents.repartition(7))


def test_tree_keeps_the_sum(spark):
    df = spark.range(3000).selectExpr("id % 2 as slot", "cast(id as string) as key", "1 + (id * 37) % 90 as size", "0.37D as part")
    got = {(r["slot"], r["key"]): r["up"] for r in mixing.pivotal_rounding(df, leaf=20, fan=3).collect()}
    assert len(got) == 3000
    for slot in (0, 1):
        rows = [r for r in df.collect() if r["slot"] == slot]
        assert abs(sum(r["size"] * got[slot, r["key"]] for r in rows) - 0.37 * sum(r["size"] for r in rows)) <= 90


def test_expectations_hold():
    size, part = np.array([5.0, 3, 8, 2, 7]), np.array([0.3, 0.6, 0.5, 0.25, 0.8])
    rng, total = np.random.default_rng(0), np.zeros(5)
    for _ in range(20_000):
        out, hand = mixing.pair_off(size, part, rng.random(5))
        total += out
    assert np.allclose(total / 20_000, part, atol=0.02)


def test_empty_table(none):
    assert mixing.mix_sources(none).count() == 0


def test_rows_that_share_an_id_keep_the_target(spark):
    """Eighty rows of ten words under ten ids; a text a row; a column named like the operator's own."""
    rows = [(k % 10, " ".join([f"w{k}"] * 10), "a" if k % 2 else "b", k) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    out = mixing.mixed_rows(df, weights=(1,), share=0.5, most=2.0)
    assert out.columns == df.columns
    got = out.collect()
    assert abs(10 * len(got) - 400) <= 20 and len({r["text"] for r in got}) == len(got)


def test_null_ids_and_clashing_names(spark):
    rows = [(None, "one two three", "a", 1, 2, 3), (None, None, None, 4, 5, 6), (3, "x " * 50, "a", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long, copy long, nth long")
    out = mixing.mixed_rows(df, share=2.0)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {None, 3}
