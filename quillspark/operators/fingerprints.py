"""Fingerprints of tables as hash trees: equal for equal rows in any order and partitioning, and, where two differ, by which leaves.

A row stands in the tree at its own SHA-256, so leaves are even whatever keys there are, and equal rows are one entry with their
number. A leaf has all rows that share so many first digits that it holds about ``leaf`` of them; a node above has sixteen children
at most. So no task and no row of the tree grows with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rows that a leaf holds about at most.
LEAF = 256


def row_digests(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(row, times): the digest of each different row's ``columns`` (all of them, by name) as a JSON list of texts, and how often it
    stands there."""
    values = F.array(*[F.col("`" + c.replace("`", "``") + "`").cast("string") for c in (columns or sorted(df.columns))])
    return df.select(F.sha2(F.to_json(values), 256).alias("row")).groupBy("row").agg(F.count("*").alias("times"))


def depth_for(rows: int, leaf: int = LEAF) -> int:
    """The fewest levels below the root by which leaves hold ``leaf`` rows on average."""
    depth = 0
    while rows > leaf * 16**depth:
        depth += 1
    return depth


def leaves(rows: DataFrame, depth: int) -> DataFrame:
    """(path, digest, n) of the leaves over (row, times)."""
    one = F.concat("row", F.lit(":"), F.col("times").cast("string"))
    return rows.groupBy(F.substring("row", 1, depth).alias("path")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ","), 256).alias("digest"), F.sum("times").alias("n"))


def tree(rows: DataFrame, depth: int) -> list[DataFrame]:
    """The levels of the tree over (row, times), the root first, each (path, digest, n); leaves are a table of their own."""
    levels = [staged(leaves(rows, depth), "tree-leaves")]
    for d in range(depth - 1, -1, -1):
        child = F.concat("path", F.lit(":"), "digest")
        up = levels[0].groupBy(F.substring("path", 1, d).alias("path"))
        levels.insert(0, up.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ","), 256).alias("digest"), F.sum("n").alias("n")))
    return levels


def revision(df: DataFrame, columns: Sequence[str] | None = None, build_date: str | None = None, leaf: int = LEAF) -> DataFrame:
    """One row (revision, n, depth, build_date): the root's digest, the number of rows, the levels below it, and the date that is
    passed through. Without rows the digest is that of an empty text."""
    rows = staged(row_digests(df, columns), "tree-rows")
    depth = depth_for(rows.count(), leaf)
    root = tree(rows, depth)[0]
    return root.agg(
        F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("revision"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.lit(depth).alias("depth"), F.lit(build_date).cast("string").alias("build_date")
    )


def differing_leaves(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """(path, was, now) of the leaves that two versions' (row, times) don't share; a digest is null where a side has no such leaf."""
    a, b = leaves(old, depth).select("path", F.col("digest").alias("was")), leaves(new, depth).select("path", F.col("digest").alias("now"))
    return a.join(b, "path", "full").where(~F.col("was").eqNullSafe(F.col("now")))


def differing_rows(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """(key, side, times) of rows that one version has and the other hasn't, or not as often: side is removed or added. Only rows of
    differing leaves are compared and only theirs are looked up again."""
    sides = [staged(row_digests(df, columns), "tree-rows") for df in (old, new)]
    depth = depth_for(max(s.count() for s in sides), leaf)
    paths = staged(differing_leaves(*sides, depth).select("path"), "tree-differing")
    within = [s.join(paths, F.substring("row", 1, depth) == F.col("path"), "left_semi") for s in sides]
    both = within[0].select("row", F.col("times").alias("was")).join(within[1].select("row", F.col("times").alias("now")), "row", "full").na.fill(0, ["was", "now"])
    changed = staged(both.where("was <> now"), "tree-changed")
    out = []
    for df, side, more in ((old, "removed", F.col("was") - F.col("now")), (new, "added", F.col("now") - F.col("was"))):
        values = F.array(*[F.col("`" + c.replace("`", "``") + "`").cast("string") for c in (columns or sorted(df.columns))])
        named = df.select(F.col(key), F.sha2(F.to_json(values), 256).alias("row")).join(changed.where(more > 0).select("row", more.alias("times")), "row")
        out.append(named.select(key, F.lit(side).alias("side"), "times").distinct())
    return out[0].unionByName(out[1])
