"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Labels are what the rules say of the URLs that they decide, and those of a labelled table, if one is given. What rules speak of
(labels of a host that rules name, and the first step of a path) is left out of every feature, so the trees can't repeat the rules;
they learn what else the decided URLs have in common. Trees are fit on a bounded sample (``TRAIN_ROWS`` different URLs, those of
least hash). Features: lengths, depth, digit ratios, entropies, counts of parameters and hyphens, and statistics of suffixes: how
many rows share the host, how many its suffixes of one and of two labels, and the share of blocked URLs among labelled ones of those
suffixes whose hosts fall in other folds. Training and served rows get them from the same tables, in one pass. From which chance on a
URL is blocked is learnt too: trees fit without one fold's hosts judge that fold, and the least of ``CUTOFFS`` by which at most
``WRONG`` of its allowed URLs are blocked, and at least ``CAUGHT`` of its blocked ones, counts; without one nothing is. All expressions
and the trees run in the JVM; suffix tables are broadcast only behind a check of their size and else joined by a shuffle, of which
Spark splits large partitions. ``held_out_errors`` gives the errors on hosts of a fold that the trees haven't seen.

Null URLs and those without ``://`` have an empty host and path and, if no rule decides, are allowed. Of equally long rules that fit,
the greatest by text and verdict wins. Very long URLs are read whole. Extra columns of any name take no part. Repeated rows are
judged each for itself and alike. Without labelled URLs of both kinds the method allows whatever no rule decides; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, small, staged

#: (verdict, host and path prefix). Fixed values.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TRAIN_ROWS, TREES, DEPTH, STEP, SEED = 10_000, 20, 4, 0.2, 7
#: Chances from which on a URL may be blocked; the share of allowed URLs of the held-out fold that may be blocked by it, and the share
#: of blocked ones that must be.
CUTOFFS, WRONG, CAUGHT = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95), 0.01, 0.1
FOLDS = 5
SMALL = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule whose host is the host or a parent of it and whose path the path
    starts with; null without one."""
    fits = []
    for verdict, rule in rules:
        cut = rule.index("/")
        own = (host == rule[:cut]) | host.endswith("." + rule[:cut])
        fits.append(F.when(own & path.startswith(rule[cut:]), F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits).cast("array<struct<size: int, rule: string, verdict: string>>"))


def entropy(text: Column) -> Column:
    """Of the characters of a text, in bits."""
    chars = F.split(text, "")
    share = lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.size(chars)
    return F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def own_host(host: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A host without the labels that a rule's host has; the first label if that leaves none."""
    spoken = sorted({x for _, rule in rules for x in rule[: rule.index("/")].split(".")})
    labels = F.split(host, r"\.")
    kept = F.filter(labels, lambda x: ~x.isin(*spoken)) if spoken else labels
    return F.when(F.size(kept) > 0, F.array_join(kept, ".")).otherwise(F.get(labels, F.lit(0)))


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "hyphens", "host_digits", "path_digits", "host_entropy", "path_entropy", "parameters", "fragment", "secure", "longest_label", "host_rows", "suffix1_rows", "suffix1_blocked", "suffix2_rows", "suffix2_blocked")


def with_features(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds FEATURES to (url, host, path, blocked: 1, 0 or null without a label, served: whether the row counts in statistics of rows)."""
    count = lambda c, x: F.regexp_count(c, F.lit(x)).cast("double")
    url = F.coalesce("url", F.lit(""))
    out = df.withColumns({"_host": own_host(F.col("host"), rules), "_path": F.regexp_replace("path", "^/[^/]*", ""), "_rest": F.regexp_extract(url, r"[?#].*$", 0)})
    host, path = F.col("_host"), F.col("_path")
    out = out.withColumns(
        {
            "length": (F.length(host) + F.length(path) + F.length("_rest")).cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length(path).cast("double"),
            "depth": count(path, "/[^/]+"),
            "labels": count(host, "[^.]+"),
            "hyphens": count(host, "-"),
            "host_digits": ratio(count(host, "[0-9]"), F.length(host)),
            "path_digits": ratio(count(path, "[0-9]"), F.length(path)),
            "host_entropy": entropy(host),
            "path_entropy": entropy(path),
            "parameters": count(F.regexp_extract("_rest", r"^\?([^#]*)", 1), "[^&=]+="),
            "fragment": F.contains(F.col("_rest"), F.lit("#")).cast("double"),
            "secure": url.startswith("https://").cast("double"),
            "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
            "_suffix1": F.substring_index(host, ".", -1),
            "_suffix2": F.substring_index(host, ".", -2),
            "_fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)),
        }
    )
    out = staged(out.drop("_host", "_path", "_rest"), "url-features")
    hosts = out.groupBy("host").agg(F.log1p(F.sum(F.col("served").cast("int"))).alias("host_rows"))
    out = out.join(small(hosts, SMALL), "host")
    for suffix in ("suffix1", "suffix2"):
        key = f"_{suffix}"
        cells = staged(out.groupBy(key, F.col("_fold").alias("f")).agg(F.sum(F.col("served").cast("int")).alias("n"), F.sum("blocked").alias("b"), F.count("blocked").alias("m")), "url-cells")
        by_fold = F.map_from_entries(F.collect_list(F.struct("f", F.struct("b", "m"))))
        known = cells.groupBy(key).agg(F.log1p(F.sum("n")).alias(f"{suffix}_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.sum("m").alias("m"), by_fold.alias("by_fold"))
        out = out.join(small(known, SMALL), key)
        own = F.try_element_at("by_fold", F.col("_fold"))
        seen, blocked = F.col("m") - F.coalesce(own["m"], F.lit(0)), F.col("b") - F.coalesce(own["b"], F.lit(0))
        # without labels of the suffix a half, to which few labels are drawn
        out = out.withColumn(f"{suffix}_blocked", (blocked + 5.0) / (seen + 10.0)).drop(key, "b", "m", "by_fold")
    return out


def train(labelled: DataFrame) -> GBTClassificationModel | None:
    """Trees from (url, FEATURES, blocked); None unless there are labels of both kinds."""
    one = labelled.groupBy("url").agg(F.max("blocked").alias("blocked"), *[F.first(c).alias(c) for c in FEATURES])
    sample = staged(one.orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS), "url-sample")
    if sample.agg(F.count_distinct("blocked")).first()[0] < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.withColumn("label", F.col("blocked").cast("double"))).select("features", "label").coalesce(2)
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(data)


def probabilities(features: DataFrame, model: GBTClassificationModel | None) -> DataFrame:
    """Adds p, the trees' chance that a URL is to be blocked; 0 without trees."""
    if model is None:
        return features.withColumn("p", F.lit(0.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)
    return model.transform(vectors).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def featured(df: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None, id_col: str, url_col: str) -> DataFrame:
    """The rows of ``df`` (served) and of ``labelled`` with their parts, labels and FEATURES."""
    rows = df.select(field(id_col).alias("id"), field(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns({"blocked": F.when(F.col("r").isNotNull(), (F.col("r.verdict") == "block").cast("int")), "served": F.lit(True)})
    if labelled is not None:
        more = labelled.where("url IS NOT NULL").select("url", "verdict").distinct()
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("id", "r")]
        more = more.select(none[0], "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), none[1], (F.col("verdict") == "block").cast("int").alias("blocked"), F.lit(False).alias("served"))
        rows = rows.unionByName(more)
    return with_features(rows, rules)


def cutoff(labelled: DataFrame, fold: int = 0) -> float | None:
    """The least of CUTOFFS by which trees that haven't seen the hosts of ``fold`` block at most WRONG of its allowed URLs and at least
    CAUGHT of its blocked ones; None if there is none, or no URL of a kind to tell by."""
    judged = probabilities(labelled.where(F.col("_fold") == fold), train(labelled.where(F.col("_fold") != fold)))
    of = {"fine": F.col("blocked") == 0, "bad": F.col("blocked") == 1}
    told = judged.agg(*[F.count_if(w).alias(n) for n, w in of.items()], *[F.count_if(w & (F.col("p") >= c)).alias(f"{n}{i}") for n, w in of.items() for i, c in enumerate(CUTOFFS)]).first()
    sure = lambda i: told[f"fine{i}"] <= WRONG * told["fine"] and told[f"bad{i}"] >= CAUGHT * told["bad"]
    return next((c for i, c in enumerate(CUTOFFS) if told["fine"] and told["bad"] and sure(i)), None)


def says_block(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """``features`` with p and says, whether trees fit on ``labelled`` block, from the cutoff that its first fold gives."""
    judged, least = probabilities(features, train(labelled)), cutoff(labelled)
    return judged.withColumn("says", F.lit(False) if least is None else F.col("p") >= least)


def held_out_errors(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", folds: Sequence[int] = range(FOLDS)) -> DataFrame:
    """(fold, n, blocked, wrong_blocks, missed) over the labelled rows: how the trees and their cutoff, fit on the hosts of all other
    folds, judge those of each fold."""
    known = staged(featured(df, rules, labelled, id_col, url_col).where("blocked IS NOT NULL"), "url-known")
    out = None
    for k in folds:
        # the fold that gives the cutoff is the first of those that are left
        rest = known.where(F.col("_fold") != k).withColumn("_fold", F.pmod(F.col("_fold") - k - 1, F.lit(FOLDS)))
        judged = says_block(known.where(F.col("_fold") == k), rest)
        one = judged.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.count_if(F.col("blocked") == 1).alias("blocked"), F.count_if((F.col("blocked") == 0) & F.col("says")).alias("wrong_blocks"), F.count_if((F.col("blocked") == 1) & ~F.col("says")).alias("missed"))
        out = one if out is None else out.unionByName(one)
    return out


def judge_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, p) for each row: the longest rule's verdict, else the trees'; p is the trees' chance for
    blocking. ``labelled``: (url, verdict) to train from beside what the rules decide."""
    features = staged(featured(df, rules, labelled, id_col, url_col), "url-rows")
    method = says_block(features.where("served"), features.where("blocked IS NOT NULL"))
    blocked = F.col("says") & (F.col("host") != "")
    verdict = F.coalesce(F.col("r.verdict"), F.when(blocked, "block").otherwise("allow"))
    return method.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.round("p", 6).alias("p"))
