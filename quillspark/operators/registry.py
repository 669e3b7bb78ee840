"""Rules over a registry of sources and its captures: validation, change, stages, approval, differences, crawling rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES


def violations(rows: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, code): every rule that a row breaks, and ``duplicate`` for all but one of rows that share a key. A rule is a
    condition that must hold; null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]
    each = rows.select(key, F.explode(F.array_compact(F.array(*broken))).alias("code"))
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.explode(F.sequence(F.lit(2).cast("long"), F.col("n")))).select(key, F.lit("duplicate").alias("code"))
    return each.unionByName(twice)


def change(old_hash: Column, old_date: Column, new_hash: Column, new_date: Column, unfetchable: Column) -> Column:
    """(verdict, reason): manual, changed or unchanged. What can't be fetched is for people; another hash or a later date is a change,
    and the hash is its reason where both are; a missing new hash or a date missing on either side never is. The reason is null where
    nothing has changed."""
    other = F.coalesce(new_hash != F.coalesce(old_hash, F.lit("")), F.lit(False))
    later = F.coalesce(new_date > old_date, F.lit(False))
    by_hand = F.coalesce(unfetchable, F.lit(False))
    return F.struct(
        F.when(by_hand, "manual").when(other | later, "changed").otherwise("unchanged").alias("verdict"),
        F.when(by_hand, "unfetchable").when(other, "hash").when(later, "date").alias("reason"),
    )


def stages(extracted: Column, cleaned_from: Column, pending: Column, chunked: Column) -> dict[str, Column]:
    """What a build must do for a source: run, skip or gate-pending, by stage."""
    ingest = F.when(extracted.isNotNull(), "skip").otherwise("run")
    clean = F.when(cleaned_from.isNull() | ~cleaned_from.eqNullSafe(extracted), "run").when(F.coalesce(pending, F.lit(False)), "gate-pending").otherwise("skip")
    return {"ingest": ingest, "clean": clean, "chunk": F.when((clean == "skip") & F.coalesce(chunked, F.lit(False)), "skip").otherwise("run")}


def embedding_stage(chunks_hash: Column, corpus_hash: Column) -> Column:
    """run or skip for the vectors of a whole corpus: skip if there is one made of these chunks."""
    return F.when(F.coalesce(chunks_hash == corpus_hash, F.lit(False)), "skip").otherwise("run")


def source_fingerprints(sources: DataFrame, extracted: DataFrame, approvals: DataFrame, chunked: DataFrame, key: str = "source") -> DataFrame:
    """(source, extracted, cleaned_from, pending, chunked): what is known of each registered source, from extractions (source, hash),
    approvals (source, hash, decision) and sources that have passages; decisions other than approved and pending count for none. Rows
    that repeat a source count once, the greatest hash."""
    one = lambda df, *more: df.groupBy(key).agg(F.max("hash").alias(more[0]), *more[1:])
    decision = F.max(F.when(F.col("decision").isin("approved", "pending"), F.struct("hash", "decision")))["decision"]
    rows = sources.select(key).distinct().join(one(extracted, "extracted"), key, "left").join(one(approvals, "cleaned_from", decision.alias("decision")), key, "left")
    rows = rows.join(chunked.select(key).distinct().withColumn("chunked", F.lit(True)), key, "left")
    return rows.select(key, "extracted", "cleaned_from", F.coalesce(F.col("decision") == "pending", F.lit(False)).alias("pending"), F.coalesce("chunked", F.lit(False)).alias("chunked"))


def chain_state(fingerprints: DataFrame, chunks_hash: str | None, corpus_hash: str | None, key: str = "source") -> tuple[DataFrame, DataFrame]:
    """(source, ingest, clean, chunk) of each source, and one row (embed, sources, n_pending, pending): what happens to the vectors of the
    whole corpus, and how many sources wait for a decision; up to a hundred of them are named, the first by name."""
    each = fingerprints.select(key, *[c.alias(n) for n, c in stages(F.col("extracted"), F.col("cleaned_from"), F.col("pending"), F.col("chunked")).items()])
    waits = each.where("clean = 'gate-pending'")
    named = waits.orderBy(key).limit(100).agg(F.array_sort(F.collect_list(key)).alias("pending"))
    counts = each.agg(F.count("*").alias("sources"), F.count_if(F.col("clean") == "gate-pending").alias("n_pending"))
    whole = counts.unionByName(named, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("sources", "n_pending", "pending")])
    return each, whole.select(embedding_stage(F.lit(chunks_hash).cast("string"), F.lit(corpus_hash).cast("string")).alias("embed"), "sources", "n_pending", "pending")


def capture_stamp(old_hash: Column, old_at: Column, new_hash: Column, now: Column) -> Column:
    """The old time of capture if the hash is the same, else now."""
    return F.when(old_hash.eqNullSafe(new_hash) & old_at.isNotNull(), old_at).otherwise(now)


def approved(input_hash: Column, output_hash: Column, approved_input: Column, approved_output: Column) -> Column:
    """Whether an approval fits exactly what went in and what came out; a missing one never does."""
    return F.coalesce((input_hash == approved_input) & (output_hash == approved_output), F.lit(False))


def block_difference(old: DataFrame, new: DataFrame, key: str, form: Column) -> DataFrame:
    """Rows of each side whose form the other side of the same key doesn't have, with side (removed or added); repeats stay."""
    a, b = old.withColumn("_form", F.xxhash64(form)), new.withColumn("_form", F.xxhash64(form))
    gone = a.join(b.select(key, "_form").distinct(), [key, "_form"], "left_anti").withColumn("side", F.lit("removed"))
    come = b.join(a.select(key, "_form").distinct(), [key, "_form"], "left_anti").withColumn("side", F.lit("added"))
    return gone.unionByName(come).drop("_form")


def path_allowed(paths: DataFrame, rules: DataFrame, path: str = "path", host: str = "host") -> DataFrame:
    """Adds allowed: the verdict of the longest rule (host, prefix, allow, ord) that the path starts with; of equally long
    ones the first; true without one. A path is asked for its prefixes, so the join is on equal keys."""
    lengths = rules.select(host, F.length("prefix").alias("_n")).groupBy(host).agg(F.sort_array(F.collect_set("_n")).alias("_ns"))
    first = rules.groupBy(host, "prefix").agg(F.min_by("allow", "ord").alias("_allow"))
    cut = paths.select(host, path).distinct().join(lengths, host).withColumn("_n", F.explode("_ns")).where(F.length(path) >= F.col("_n"))
    hits = cut.withColumn("prefix", F.substr(F.col(path), F.lit(1), F.col("_n"))).join(first, [host, "prefix"])
    best = hits.groupBy(host, path).agg(F.max_by("_allow", "_n").alias("_best"))
    return paths.join(best, [host, path], "left").withColumn("allowed", F.coalesce("_best", F.lit(True))).drop("_best")


def unique_ids(spans: DataFrame, base: str, order: Sequence[str]) -> DataFrame:
    """Adds id: ``base`` for the first of its kind, then base-1, base-2 and so on."""
    nth = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    return spans.withColumn("id", F.when(nth == 0, F.col(base)).otherwise(F.concat(base, F.lit("-"), nth.cast("string"))))


def sections(blocks: DataFrame, doc: str, order: str, heading: Column) -> DataFrame:
    """Adds section: the last heading up to and with the block."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def span_faults(spans: DataFrame, texts: DataFrame, doc: str, text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """(doc, fault, at) of the first thing wrong with how spans (doc, start, end) cover the texts (doc, text): an overlap, at the span's
    start, or a gap that isn't white space alone, at the end of what came before. Spans count in the order of their starts, then
    ends; what follows the last, and a text without spans, are held to it too. Texts covered well are left out.

    Spans that adjoin drop out before anything is joined; of the others a text gets one row, however many there are."""
    order = Window.partitionBy(doc).orderBy(start, end)
    cut = spans.select(doc, F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("e"), F.coalesce(F.lag(end).over(order), F.lit(0)).cast("int").alias("p"), F.row_number().over(order).alias("k"))
    # every text has what came before each break, and where its last span ends
    held = cut.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("s") != F.col("p"), F.struct("k", "s", "p")))).alias("breaks"), F.max_by("e", "k").alias("last"))
    rows = texts.select(doc, text).join(held, doc, "left")
    breaks = F.coalesce("breaks", F.array().cast("array<struct<k: int, s: int, p: int>>"))
    size, last = F.length(text), F.coalesce("last", F.lit(0))
    tail = F.struct(F.lit(2147483647).alias("k"), F.greatest(size, last).alias("s"), last.alias("p"))
    piece = lambda x: F.substr(F.col(text), x["p"] + 1, F.greatest(x["s"] - x["p"], F.lit(0)))
    faults = F.transform(F.concat(breaks, F.array(tail)), lambda x: F.when(x["s"] < x["p"], F.struct(F.lit("overlap").alias("fault"), x["s"].alias("at"))).when(piece(x).rlike(f"[^{SPACES}]"), F.struct(F.lit("gap").alias("fault"), x["p"].alias("at"))))
    first = F.get(F.array_compact(faults), F.lit(0))
    return rows.select(doc, first.alias("f")).where("f IS NOT NULL").select(doc, "f.fault", "f.at")


def document_states(held: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc, state, stale): held, outdated or absent for each document (doc, version) from held copies (doc, version), and
    the copies of other versions in order."""
    copies = held.groupBy("doc").agg(F.array_sort(F.collect_set("version")).alias("_have"))
    stale = F.array_except(F.coalesce("_have", F.array().cast("array<string>")), F.array("version"))
    state = F.when(F.array_contains("_have", F.col("version")), "held").when(F.size("_have") > 0, "outdated").otherwise("absent")
    return documents.join(copies, "doc", "left").select("doc", state.alias("state"), stale.alias("stale"))
