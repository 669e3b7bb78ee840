import hashlib
import math

import numpy as np
import pytest

from quillspark.llm import ball_kmeans as bk
from quillspark.llm import queries

from .oracle import same


def plain(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        new = []
        for j, c in enumerate(cs):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            new.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c)
        cs = new
    last = [nearest(v) for _, v in kept]
    inertia = {j: sum(d for d, a in last if a == j) for j in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    fit = lambda x: x if x < 1 << 63 else None
    sure = {j: all(d < 1 << 63 for d, a in last if a == j) for j in range(len(cs))}
    return sorted((repr((i, j, fit(d), fit(inertia[j]) if sure[j] else None, fit(sum(inertia.values())) if all(sure.values()) else None, sha[j])) for (i, _), (d, j) in zip(kept, last, strict=True)))


def got(df, **how):
    return sorted(repr(tuple(r)) for r in bk.ball_kmeans(df, **how).collect())


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_ties_negative_parts_and_empty_clusters(spark):
    """Few distinct points on a grid: ties everywhere, repeated rows, clusters that lose all members."""
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.integers(-2, 3, 4) / 1024).tolist()) for i in range(150)]
    rows += rows[:9] + [(None, [0.0] * 4), (None, None), (200, [0.0] * 3), (201, [math.nan] + [0.0] * 3), (202, [math.inf] + [0.0] * 3), (203, [None] + [0.0] * 3), (204, [-0.0001] * 4)]
    df = frame(spark, rows).repartition(5)
    assert got(df, dims=4) == plain(rows, dims=4)
    same_points = [(i, [1.0] * 4) for i in range(20)]
    assert got(frame(spark, same_points), dims=4) == plain(same_points, dims=4)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(i, [float(i), 0.5]) for i in range(3)]
    assert got(frame(spark, rows), dims=2) == plain(rows, dims=2)
    assert got(frame(spark, rows).where("false"), dims=2) == [] and got(frame(spark, rows), dims=9) == []


def test_vast_components(spark):
    rows = [(i, [(-1) ** i * 10.0 ** (i * 12), i / 3]) for i in range(25)] + [(50, [1.7e308, -1.7e308])]
    assert got(frame(spark, rows), dims=2) == plain(rows, dims=2)


def test_any_guess_gives_the_nearest():
    rng = np.random.default_rng(2)
    for spread in (1, 5, 1000, 1 << 22):
        v = rng.integers(-spread, spread + 1, (500, 6))
        cs = rng.integers(-spread, spread + 1, (8, 6)).tolist()
        d = np.array([[sum((int(x) - y) ** 2 for x, y in zip(r, c, strict=True)) for c in cs] for r in v])
        for guess in (np.zeros(500, np.int64), rng.integers(0, 8, 500)):
            near, best = bk.reassigned(v, guess, cs)
            assert (near == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_cores_are_not_compared(monkeypatch):
    """Members of well apart balls meet no other centroid."""
    calls = []
    real = bk.squared
    monkeypatch.setattr(bk, "squared", lambda a, b: calls.append(len(a)) or real(a, b))
    cs = [[1000 * j, 0] for j in range(8)]
    v = np.array([[1000 * j + e, e] for j in range(8) for e in range(100)])
    near, _ = bk.reassigned(v, np.repeat(np.arange(8), 100), cs)
    assert (near == np.repeat(np.arange(8), 100)).all() and sum(calls) == 800 + 8 * 8


def test_extra_columns(spark):
    rows = [(i, [i / 7, -i / 3]) for i in range(30)]
    df = frame(spark, rows).selectExpr("*", "'x' AS cluster", "1 AS id", "2 AS v", "3 AS distance", "4 AS sums")
    assert got(df, dims=2) == plain(rows, dims=2)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, folder):
    assert same(spark, queries.op12_ball_kmeans, bk.oracle(), folder)
