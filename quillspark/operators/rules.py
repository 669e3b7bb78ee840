"""Rules over whole rows and tables: patterns by line, limits of sizes, lists of words, requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import margin


def pattern_hits(rows: DataFrame, key: str, text: Column, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, line, token): every line (from 1) in which a pattern, given with its name, stands. Lines are exploded once and the
    patterns, a short list, are tried in the row."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    hits = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(name)) for name, p in patterns]))
    return lines.select(key, (F.col("line") + 1).cast("long").alias("line"), F.explode(hits).alias("token"))


def lacking(rows: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows that have no equal key in ``other``, repeats kept."""
    return rows.join(other.select(on).distinct(), on, "left_anti")


def placement(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """One row (ok, missing, first): whether each row has an equal key in ``other``, how many keys haven't, and the least of them."""
    gone = lacking(rows, other, on).select(on).distinct()
    return gone.agg((F.count("*") == 0).alias("ok"), F.count("*").alias("missing"), F.min(on).alias("first"))


def limit_plan(lines: DataFrame, group: str | None = None) -> DataFrame:
    """From (line, counted, base, limit, raised, measured, current): what a limit becomes. ``counted`` lines need no margin. A
    line that measures more than is allowed is refused with what it would need; one refusal refuses all changes (of its group)."""
    spare = F.when(F.col("counted"), F.lit(0).cast("long")).otherwise(margin(F.col("measured") - F.col("base")))
    raised = F.coalesce("raised", F.lit(0)) > 0
    allowed = F.when(raised, F.col("limit") + F.col("raised")).otherwise(F.col("current"))
    out = lines.withColumns({"allowed": allowed, "need": F.col("measured") + spare})
    out = out.withColumn("refused", F.col("measured") > F.col("allowed"))
    to = F.when(raised, F.least("need", "allowed")).otherwise(F.col("current"))
    every = Window.partitionBy(group) if group else Window.partitionBy()
    out = out.withColumn("ok", ~F.max("refused").over(every))
    return out.withColumn("to", F.when(F.col("ok") & (to > F.col("current")), to))


def final_plan(lines: DataFrame, group: str | None = None) -> DataFrame:
    """The same at a plan's end: raised limits come down to what is measured and its margin; more than the limit is refused."""
    spare = F.when(F.col("counted"), F.lit(0).cast("long")).otherwise(margin(F.col("measured") - F.col("base")))
    out = lines.withColumns({"need": F.col("measured") + spare, "refused": F.col("measured") > F.col("current")})
    every = Window.partitionBy(group) if group else Window.partitionBy()
    lower = (F.coalesce("raised", F.lit(0)) > 0) & (F.col("current") - F.col("measured") > spare)
    return out.withColumn("ok", ~F.max("refused").over(every)).withColumn("to", F.when(F.col("ok") & lower, F.col("need")))


def greatest_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the greatest of each column."""
    return rows.agg(*[F.max(c).alias(c) for c in columns])



def word_faults(rows: DataFrame, line: str, parts: int = 2) -> DataFrame:
    """Adds fault: shape, where a line isn't ``parts`` tokens with tabs between, or repeat, where its word stands in more than one
    line; null otherwise. ``word`` is its last token for two parts and more, ``head`` its first."""
    cut = F.split(line, "\t")
    good = (F.size(cut) == parts) & F.forall(cut, lambda x: x.rlike("^[^\\x00-\\x20\\x7f]+$"))
    out = rows.withColumns({"head": F.get(cut, F.lit(0)), "word": F.get(cut, F.lit(parts - 1)), "_good": good})
    many = out.where("_good").groupBy("word").agg(F.count("*").alias("_n"))
    out = out.join(many, "word", "left")
    return out.withColumn("fault", F.when(~F.col("_good"), "shape").when(F.col("_n") > 1, "repeat")).drop("_good", "_n")


def removal_faults(removals: DataFrame, known: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """Adds fault to removals (word, reason): reason, unknown_word or duplicate; null otherwise."""
    many = removals.groupBy("word").agg(F.count("*").alias("_n"))
    mark = known.select("word").distinct().withColumn("_known", F.lit(True))
    out = removals.join(many, "word").join(mark, "word", "left")
    fault = F.when(~F.col("reason").isin(*reasons), "reason").when(F.col("_known").isNull(), "unknown_word").when(F.col("_n") > 1, "duplicate")
    return out.withColumn("fault", fault).drop("_n", "_known")


def curated(words: DataFrame, removed: DataFrame, least: int) -> DataFrame:
    """(word): words that aren't removed, in the order of their code units. Raises where one isn't a-z alone or fewer than
    ``least`` stay."""
    kept = lacking(words.select("word"), removed, "word")
    state = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum((~F.col("word").rlike("^[a-z]+$")).cast("int")), F.lit(0)).alias("odd")).first()
    if state["odd"]:
        raise ValueError("a word has other signs than letters a to z")
    if state["n"] < least:
        raise ValueError("too few words are left")
    return kept.orderBy("word")


def superseded(held: DataFrame, shipped: DataFrame, namespaces: Sequence[str], by_document: Sequence[str] = ()) -> DataFrame:
    """(path) of ``held`` that a build has replaced: in a namespace of which ``shipped`` (path) has something but not this path; in
    the namespaces ``by_document``, not this document (the name up to its last full stop and hash)."""
    space = F.coalesce(*[F.when(F.col("path").startswith(n), F.lit(n)) for n in namespaces])
    whole = ~space.isin(*by_document) if by_document else F.lit(True)
    document = F.regexp_extract("path", r"^(.*?)[.-][0-9a-f]{8,64}\.[a-z0-9]+$", 1)
    keyed = lambda df: df.withColumn("space", space).where("space IS NOT NULL").withColumn("key", F.when(whole, F.col("path")).otherwise(document))
    now = keyed(shipped.select("path"))
    return keyed(held.select("path")).join(now.select("space").distinct(), "space", "left_semi").join(now.select("space", "key").distinct(), ["space", "key"], "left_anti").select("path")
