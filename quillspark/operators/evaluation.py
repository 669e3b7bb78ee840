"""Measures of ranked lists, frozen splits, grids of parameters and paired exact tests."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_bucket

ALPHA = 0.05


def hit_rate(lists: DataFrame, k: int, ranked: str = "ranked", expected: str = "expected") -> DataFrame:
    """One row: n and hit_rate, the share of lists with an expected member among their first ``k``; 0 without lists."""
    hit = F.arrays_overlap(F.slice(ranked, 1, k), F.col(expected)).cast("int")
    return lists.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce(hit, F.lit(0))), F.lit(0.0)).alias("hit_rate"))


def reciprocal_rank(ranked: Column, expected: Column) -> Column:
    """1 over the place of the first expected member in the whole list; 0 if there is none."""
    places = F.transform(ranked, lambda x, i: F.when(F.array_contains(expected, x), i + 1))
    return F.coalesce(1 / F.array_min(F.array_compact(places)), F.lit(0.0))


def mean_reciprocal_rank(lists: DataFrame, ranked: str = "ranked", expected: str = "expected") -> DataFrame:
    return lists.agg(F.coalesce(F.avg(reciprocal_rank(F.col(ranked), F.col(expected))), F.lit(0.0)).alias("mrr"))


def measures_of_ranks(ranks: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """One row: n, hit_rate (share of first expected ranks up to ``k``) and mrr (mean of one over the rank, which is never cut; a null
    rank counts as 0)."""
    hit = F.coalesce((F.col(rank) <= k).cast("int"), F.lit(0))
    return ranks.agg(F.count("*").alias("n"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.avg(F.coalesce(1 / F.col(rank), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def split(queries: DataFrame, text: Column, held_out: int = 30) -> DataFrame:
    """Adds bucket and held_out: frozen by the text, so both parts together are all and have nothing in common."""
    return queries.withColumn("bucket", split_bucket(text)).withColumn("held_out", F.col("bucket") < held_out)


def at_places(df: DataFrame, column: str, places: Sequence[int], n: int) -> list:
    """Values at zero-based places of the sorted column: exact, one aggregate over the counts of its values."""
    asked = [F.expr(f"percentile_disc({(p + 0.5) / n!r}) WITHIN GROUP (ORDER BY `{column}`)").alias(f"p{i}") for i, p in enumerate(places)]
    return list(df.agg(*asked).first())


def cutoff_candidates(df: DataFrame, column: str) -> DataFrame:
    """(candidate): 0 and the lower quartiles by nearest rank, floor(p (n - 1)), without repeats."""
    n = df.where(F.col(column).isNotNull()).count()
    values = at_places(df, column, [int(p * (n - 1) / 100) for p in (25, 50, 75)], n) if n else []
    return df.sparkSession.createDataFrame([(float(x),) for x in sorted({0.0, *map(float, values)})], "candidate double")


def upper_median(df: DataFrame, column: str) -> float:
    """The value at floor(n / 2) of the sorted column; 0 without values."""
    n = df.where(F.col(column).isNotNull()).count()
    return float(at_places(df, column, [n // 2], n)[0]) if n else 0.0


def grid_rates(scores: DataFrame, alphas: Sequence[float], min_bm25s: Sequence[float], min_scores: Sequence[float], k: int = 5) -> DataFrame:
    """(combo, alpha, min_bm25, min_score, hit_rate, mrr, correct_empty) for each combination, in the order of the product.
    ``scores``: query_id, id, cosine, bm25, relevant (whether id's source is one of the expected), positive (whether the
    query expects anything). A short literal grid is exploded beside each row; ranks are taken within query and combination."""
    grid = [(i, float(a), float(b), float(s)) for i, (a, b, s) in enumerate(product(alphas, min_bm25s, min_scores))]
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("combo"), F.lit(a).alias("alpha"), F.lit(b).alias("min_bm25"), F.lit(s).alias("min_score")) for i, a, b, s in grid])
    top = F.max("bm25").over(Window.partitionBy("query_id"))
    rows = scores.withColumn("_lexical", F.when(top > 0, F.col("bm25") / top).otherwise(0.0)).withColumn("_c", F.explode(cells)).select("*", "_c.*")
    fused = rows.withColumn("_score", F.col("cosine") * F.col("alpha") + F.col("_lexical") * (1 - F.col("alpha")))
    kept = fused.withColumn("_in", (F.col("bm25") >= F.col("min_bm25")) & (F.col("_score") >= F.col("min_score")))
    place = F.row_number().over(Window.partitionBy("combo", "query_id").orderBy(F.desc("_in"), F.desc(F.round("_score", 9)), "id"))
    kept = kept.withColumn("_place", place).withColumn("_in", F.col("_in") & (F.col("_place") <= k))
    each = kept.groupBy("combo", "alpha", "min_bm25", "min_score", "query_id").agg(
        F.max("positive").alias("positive"), F.max("_in").alias("any"), F.min(F.when(F.col("_in") & F.col("relevant"), F.col("_place"))).alias("first")
    )
    yes = F.col("positive")
    return each.groupBy("combo", "alpha", "min_bm25", "min_score").agg(
        F.coalesce(F.avg(F.when(yes, F.col("first").isNotNull().cast("int"))), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(F.when(yes, F.coalesce(1 / F.col("first"), F.lit(0.0)))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(~yes, (~F.col("any")).cast("int"))), F.lit(1.0)).alias("correct_empty"),
    )


def best_of_grid(rates: DataFrame) -> DataFrame:
    """The combination of greatest hit_rate + mrr; of equal ones the first."""
    return rates.orderBy(F.desc(F.round(F.col("hit_rate") + F.col("mrr"), 12)), "combo").limit(1)


def sign_test(b: Column, c: Column) -> Column:
    """Exact two-sided chance of so uneven a split of b + c disagreements; 1 if there are none. Terms of the binomial follow
    from one another."""
    n, low = b + c, F.least(b, c)
    steps = F.when(low > 0, F.sequence(F.lit(1).cast("long"), low.cast("long"))).otherwise(F.array().cast("array<long>"))
    first = n.cast("double") * F.log(F.lit(0.5))
    # in logarithms: the first term vanishes for n of a thousand and more

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i)
        top = F.greatest(a["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(-F.abs(a["sum"] - term)))).alias("sum"))

    total = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step, lambda a: F.exp(a["sum"]))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def bar_passed(gained: Column, lost: Column, significant: bool, alpha: float = ALPHA) -> Column:
    """Whether more was gained than lost and, if asked for, not by chance."""
    ok = gained > lost
    return ok & (sign_test(gained, lost) < alpha) if significant else ok


def calibrated_cutoff(best: DataFrame, cutoffs: Sequence[float], floor: float, score: str = "score") -> DataFrame:
    """(cutoff): the highest that still leaves ``floor`` of all queries a relevant result; 0 if none does. ``best`` has a row
    for each query: the score of its best relevant result among those that count, or null."""
    rates = best.agg(*[F.avg((F.coalesce(F.col(score), F.lit(-1.0)) >= c).cast("int")).alias(f"r{i}") for i, c in enumerate(cutoffs)])
    held = F.array_compact(F.array(*[F.when(F.col(f"r{i}") >= floor, F.lit(float(c))) for i, c in enumerate(cutoffs)]))
    return rates.select(F.coalesce(F.array_max(held), F.lit(0.0)).alias("cutoff"))
