"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should get. The whole part is taken at
once; the fractional parts are rounded in pairs: words move at random from one document to the other until one of the two
has a whole number of copies, so that the words taken from the pair stay what they were and each document's expectation
too. Leaves of a bounded number of documents do this first and leave one undecided document each; residuals of ``FAN``
leaves meet at the next level, until one is left in a source, which a last draw decides. Words taken thus miss the target
by less than one document. All draws come from hashes of keys and a seed, so reruns and recomputed tasks agree.

Documents without words are never taken and never drawn on. Null and empty texts have size 0; null sources are a source;
repeated rows are rows of their own and may get different numbers of copies; an empty table gives an empty one. Targets
are capped at ``most`` times a source's size, the excess going to the others by weight. Very long texts are measured whole, each in
its row; other columns, of any name, travel along or aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, small, staged

#: Documents in a leaf, on average; residuals that meet in a node of the tree.
LEAF, FAN = 2048, 256
#: Source tables of at most so many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 10_000
TINY = 1e-9


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space and the five ASCII controls 9-13; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, a short table by nature.
    ``weights`` repeat over the sources by code point, null last. Reads as water-filling: in the order of cap over weight,
    sources are full as long as the rest would give the next more than its cap."""
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("pos", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # the level of the first that isn't full holds for it and all after it
    first = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("need"), "pos", "level"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(first["level"] * F.col("weight"))
    return filled.select("source", "source_size", F.least(target, F.col("cap")).alias("target"))


def pair_off(size: np.ndarray, part: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds all of ``part`` but one to 0 or 1, in order; returns the parts and the index of the one left (-1: none).
    A step moves words between the one in hand and the next: up or down by as much as makes one whole, with the chances
    that keep both expectations."""
    part, hand = part.copy(), -1
    for i in range(len(part)):
        if not TINY < part[i] < 1 - TINY:
            part[i] = round(part[i])
            continue
        if hand < 0:
            hand = i
            continue
        a, b = size[hand], size[i]
        up = min((1 - part[hand]) * a, part[i] * b)  # words that can go to the one in hand
        down = min(part[hand] * a, (1 - part[i]) * b)
        move = up if draws[i] * (up + down) < down else -down
        part[hand] += move / a
        part[i] -= move / b
        for k in (hand, i):
            if part[k] < TINY or part[k] > 1 - TINY:
                part[k] = round(part[k])
        open_ = [k for k in (hand, i) if 0 < part[k] < 1]
        hand = open_[-1] if open_ else -1
    return part, hand


def _rounded(level: int, seed: int):
    """A node: rows of (key, size, part) by falling size; all but one get a whole part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.Generator(np.random.PCG64([seed, level, *(int(x) & (2**64 - 1) for x in pdf[["slot", "node"]].iloc[0])]))
        part, hand = pair_off(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), rng.random(len(pdf)))
        return pdf.assign(part=part, open=np.arange(len(pdf)) == hand)[["slot", "node", "key", "size", "part", "open"]]

    return run


NODE = "slot long, node long, key string, size long, part double, open boolean"


def pivotal_rounding(parts: DataFrame, seed: int = 0, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(slot, key, up) from (slot, key, size, part): within each slot, ``part`` rounded to 0 or 1 so that the words taken
    keep their sum. ``key`` names a row within its slot. Levels: leaves by hash of the key, then residuals by node number."""
    spark = parts.sparkSession
    counts = staged(parts.groupBy("slot").agg(F.ceil(F.count("*") / leaf).alias("leaves")), "mix-leaves")
    now = parts.join(small(counts, SMALL), "slot").withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("leaves"))).drop("leaves")
    nodes = counts.agg(F.max("leaves")).first()[0] or 0
    decided, level = [], 0
    while True:
        done = staged(now.select("slot", "node", "key", "size", "part").groupBy("slot", "node").applyInPandas(_rounded(level, seed), NODE), "mix-level")
        decided.append(done.where("not open").select("slot", "key", (F.col("part") > 0.5).alias("up")))
        now = done.where("open").withColumn("node", F.expr(f"node div {fan}"))
        if nodes <= 1:
            break
        nodes, level = math.ceil(nodes / fan), level + 1
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("last"), "slot", "key"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    decided.append(now.select("slot", "key", (draw < F.col("part")).alias("up")))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def drawn(df: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, nth, source_size, target, copies): rows that agree in the first three are told apart by their
    number among their like, so that each is rounded for itself."""
    narrow = df.select(field(id_col).alias("doc_id"), field(source_col).alias("source"), size_of(field(text_col)).alias("size"))
    narrow = staged(narrow, "mix-sizes")
    sources = staged(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("slot", F.xxhash64("source")), "mix-targets")
    rows = narrow.groupBy("doc_id", "source", "size").agg(F.count("*").alias("like")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("like"))))
    joined = rows.join(small(sources, SMALL), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    near = F.when(F.abs(each - F.round(each)) < TINY, F.round(each)).otherwise(each)
    wide = joined.withColumn("copies", F.when(F.col("size") > 0, near).otherwise(0.0)).withColumn("whole", F.floor("copies")).withColumn("part", F.col("copies") - F.col("whole"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "nth")
    wide = staged(wide.select("doc_id", "source", "size", "nth", "source_size", "target", "slot", "whole", "part", key.alias("key")), "mix-parts")
    ups = pivotal_rounding(wide.where("part > 0").select("slot", "key", "size", "part"), seed).where("up").select("slot", "key").withColumn("extra", F.lit(1))
    got = wide.join(ups, ["slot", "key"], "left").withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long"))
    return got.select("doc_id", "source", "size", "nth", "source_size", "target", "copies")


def mix_sources(
    df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, source, size, source_size, target (of the source), copies (how often the mix takes the row) and taken
    (copies times size), one row for each row of ``df``."""
    got = drawn(df, weights, share, most, seed, id_col, text_col, source_col)
    return got.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(
    df: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``df`` as the mix takes it: each row as often as its copies say, with all its columns. Rows that share an id are
    numbered among those of equal source and size, and each gets its own draw; only then are texts shuffled for it. Rows travel
    as one struct, so no name of a column matters."""
    got = staged(drawn(df, weights, share, most, seed, id_col, text_col, source_col).select("doc_id", "source", "size", "nth", "copies"), "mix-drawn")
    twice = got.groupBy("doc_id").count().where("count > 1").limit(1).count()
    rows = df.select(field(id_col).alias("doc_id"), F.struct(*[field(c) for c in df.columns]).alias("row"))
    keys = ["doc_id"]
    if twice:
        rows = rows.withColumns({"source": F.col("row").getField(source_col), "size": size_of(F.col("row").getField(text_col))})
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.to_json("row"))).cast("long"))
        keys = ["doc_id", "source", "size", "nth"]
    taken = got.where("copies > 0").select(*[F.col(k).alias(f"of_{k}") for k in keys], "copies")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    out = rows.join(small(taken, SMALL * 50), same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select("row.*")
