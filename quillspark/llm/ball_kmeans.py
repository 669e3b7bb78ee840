"""Centroid clustering by ball k-means over integer vectors: exact rounds in which most members are compared with few centroids.

Vectors become whole numbers, so all distances are exact. They are held in blocks of at most BATCH_ROWS vectors, one block a row,
with the cluster of each member. In a round a block's members of a cluster are a ball around its centroid. Another centroid is a
neighbour of the ball if it is no farther than two radii; members closer to their centroid than half the way to the nearest
neighbour are the ball's stable core and stay; the others lie in annuli between one neighbour's half way and the next one's, and are
compared with the neighbours up to theirs alone. Half ways are compared as four times a squared distance, strictly, so that ties
are always looked at and go to the smaller number.

A round writes the blocks with their new members and, beside them, sums for each cluster; the next centroids come from the sums'
columns alone. What passes through the driver are the centroids. Blocks are tables in the shared folder, the one before goes.

Kept are vectors of exactly ``dims`` components without null, NaN or infinity. With fewer vectors than clusters there are as many
clusters as vectors. The first centroids are the vectors of the smallest digests; equal digests (repeated ids) are ordered by
components; a null id comes last. Repeated rows are vectors of their own. Components of any size are exact (beyond 27 bits by whole
numbers without bound); a squared distance or a sum that no long holds is null. Other columns are not read. An empty table, or one
without such vectors, gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, field, small_batches, staged

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Below this four times a squared distance of up to MOST components stays within 63 bits.
NARROW, MOST = 1 << 26, 100
LONG = 1 << 63
#: Tasks that add up what the tasks over blocks have added.
TASKS = 16


def kept_vectors(vec: Column, dims: int = DIMS) -> Column:
    """Whether a vector has exactly ``dims`` components, none null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(vec) == dims) & F.forall(vec, lambda x: fine(x.cast("double"))), F.lit(False))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit numbers where all are narrow, else as unbounded ones. ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if (np.abs(scaled) < NARROW).all():
        return scaled.astype(np.int64)
    out = [int(np.floor(v * scale)) if abs(v) < 2.0**52 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(out, object).reshape(x.shape)


def packed(v: np.ndarray) -> tuple[bytes, int]:
    """Little-endian bytes of whole numbers, and the width of each."""
    if v.dtype != object:
        return v.astype("<i4").tobytes(), 4
    width = max((int(x).bit_length() // 8 + 1 for x in v.ravel()), default=4)
    return b"".join(int(x).to_bytes(width, "little", signed=True) for x in v.ravel()), width


def unpacked(data: bytes, width: int, dims: int) -> np.ndarray:
    if width == 4:
        return np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, dims)
    return np.array([int.from_bytes(data[i : i + width], "little", signed=True) for i in range(0, len(data), width)], object).reshape(-1, dims)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def reassigned(v: np.ndarray, cluster: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (ties: smaller number) and its squared distance for each row of ``v``; ``cluster`` is where the
    rows are now, any guess is right."""
    wide = v.dtype == object or v.shape[1] > MOST or any(abs(x) >= NARROW for c in centroids for x in c)
    c = np.array(centroids, object if wide else np.int64)
    v = v.astype(object) if wide else v
    best, near = squared(v, c[cluster]), cluster.copy()
    own = best.copy()
    for j in np.unique(cluster):
        members = np.flatnonzero(cluster == j)
        reach = 4 * own[members]
        apart = squared(c, c[j])
        # neighbours by distance; a ball's others are farther than two radii
        order = [i for i in sorted(range(len(c)), key=lambda i: (apart[i], i)) if i != j and apart[i] <= reach.max()]
        for i in order:
            far = members[reach >= apart[i]]  # from this neighbour's half way outwards
            d = squared(v[far], c[i])
            nearer = (d < best[far]) | ((d == best[far]) & (i < near[far]))
            best[far[nearer]], near[far[nearer]] = d[nearer], i
    return near, best


def long_or_none(x: int) -> int | None:
    return int(x) if -LONG <= x < LONG else None


BLOCK = "ids {id}, width int, v binary, cluster binary, sums array<struct<cluster: int, n: long, sum: array<string>>>"


def block_of(ids: pa.Array, v: np.ndarray, cluster: np.ndarray) -> dict:
    """A block's row: members, and count and exact sums of each cluster in it."""
    data, width = packed(v)
    sums = []
    for j in np.unique(cluster).tolist():
        mine = v[cluster == j]
        sums.append({"cluster": j, "n": len(mine), "sum": [str(s) for s in mine.sum(axis=0).tolist()]})
    return {"ids": ids.to_pylist(), "width": width, "v": data, "cluster": cluster.astype("<i4").tobytes(), "sums": sums}


def centroids_after(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each non-empty cluster's componentwise floor of the mean; empty ones stay. Reads the sums alone: a task adds up its own,
    TASKS tasks add up those, and their few rows are added here."""

    def added(rows: Iterator[dict]) -> list[dict]:
        total: dict[int, list] = {}
        for r in rows:
            known = total.setdefault(r["cluster"], [0, [0] * len(r["sum"])])
            known[0] += r["n"]
            known[1] = [x + int(y) for x, y in zip(known[1], r["sum"], strict=True)]
        return [{"cluster": j, "n": n, "sum": [str(x) for x in s]} for j, (n, s) in total.items()]

    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = added(row for batch in batches for row in batch.to_pylist())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sum", pa.list_(pa.string()))]))

    form = "cluster int, n long, sum array<string>"
    sums = blocks.select(F.inline("sums")).select("cluster", "n", "sum").mapInArrow(adding, form)
    out = [list(c) for c in centroids]
    for r in added(r.asDict() for r in sums.repartition(TASKS).mapInArrow(adding, form).collect()):
        out[r["cluster"]] = [int(s) // r["n"] for s in r["sum"]]
    return out


def mapped(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in work(batch):
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return df.mapInArrow(run, schema)


def ball_kmeans(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector after ``rounds`` rounds."""
    id_type = dict(df.select(field(id_col).alias("id")).dtypes)["id"]
    rows = df.where(kept_vectors(field(vec_col), dims)).select(field(id_col).alias("id"), field(vec_col).cast("array<double>").alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), F.col("v")).limit(k).collect()
    centroids = [[int(x) for x in whole(np.array([r["v"]]), scale)[0]] for r in first]
    schema = BLOCK.format(id=f"array<{id_type}>")

    def packing(batch: pa.RecordBatch) -> Iterator[dict]:
        v = whole(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
        near, _ = reassigned(v, np.zeros(len(v), np.int64), centroids)
        yield block_of(batch.column("id"), v, near)

    def members(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for i in range(batch.num_rows):
            v = unpacked(batch.column("v")[i].as_py(), batch.column("width")[i].as_py(), dims)
            yield batch.column("ids")[i].values, v, np.frombuffer(batch.column("cluster")[i].as_py(), "<i4").astype(np.int64)

    def moving(centroids: list[list[int]]) -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for ids, v, cluster in members(batch):
                yield block_of(ids, v, reassigned(v, cluster, centroids)[0])

        return work

    def ending(batch: pa.RecordBatch) -> Iterator[dict]:
        for ids, v, cluster in members(batch):
            near, d = reassigned(v, cluster, centroids)
            yield {"vec_id": ids.to_pylist(), "cluster": near.tolist(), "distance": [long_or_none(x) for x in d.tolist()]}

    blocks = None
    for r in range(rounds if centroids else 0):
        moved = mapped(rows, schema, packing) if blocks is None else mapped(blocks.select("ids", "width", "v", "cluster"), schema, moving(centroids))
        after = staged(moved, "balls")
        dropped(blocks)
        blocks = after
        centroids = centroids_after(blocks, centroids)
    out_schema = f"vec_id array<{id_type}>, cluster array<int>, distance array<long>"
    if blocks is None:
        ended = rows.where("false").select(F.array("id").alias("vec_id"), F.array(F.lit(0)).alias("cluster"), F.array(F.lit(0).cast("long")).alias("distance"))
    else:
        ended = staged(mapped(blocks.select("ids", "width", "v", "cluster"), out_schema, ending), "balls-ended")
        dropped(blocks)
    found = ended.select(F.explode(F.arrays_zip("vec_id", "cluster", "distance")).alias("m")).select("m.*")
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), (F.count("*") == F.count("distance")).alias("sure")).collect()
    total, sure = sum(int(r["s"] or 0) for r in per), all(r["sure"] for r in per)
    of = {r["cluster"]: long_or_none(int(r["s"])) if r["sure"] else None for r in per}
    sha = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(centroids)}

    def looked_up(values: dict, kind: str) -> Column:
        known = [x for j, v in sorted(values.items()) for x in (F.lit(j), F.lit(v).cast(kind))]
        return F.element_at(F.create_map(*known), F.col("cluster")) if known else F.lit(None).cast(kind)

    return found.select(
        "vec_id", "cluster", "distance", looked_up(of, "long").alias("cluster_inertia"), F.lit(long_or_none(total) if sure else None).cast("long").alias("inertia"), looked_up(sha, "string").alias("centroid_sha256")
    )


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for the rows of ball_kmeans over embeddings: plain rounds over all centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM
  (SELECT row, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM vectors, m{r}) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT c, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{r} JOIN vectors USING (row), (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY c, i),
m{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(x.m, o.m) AS m FROM m{r} o LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY c) x USING (c))""")
    last = rounds
    return f"""
WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM vectors ORDER BY h, v LIMIT {k})),{",".join(steps)},
told AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{last} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM told)::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{last} JOIN vectors USING (row) JOIN told USING (c) JOIN m{last} USING (c)
"""
