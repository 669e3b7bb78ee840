"""Filter interaction audit: what each of five filters removes in each order, from a histogram of failure masks.

Native expressions turn a row into five bits, one for each filter it fails; four of them need its text alone, the fifth whether
a row with a smaller id has the same text. Texts are read once and leave their scan as digests: rows are counted by id, digest,
part and bits, then by digest, so that a group of copies of any size is one short row in each task before it is shuffled. What is
left are 32 cells a part, and all orders come from the cells.

Null texts are empty. A null part is the empty string's part. A row without an id is no one's original and fails nothing for
being a copy. Rows that repeat an id count as often as they stand there and don't make each other copies. Labels that repeat an
id count once: good or toxic if any of them says so; labels without a row have no effect. Very long texts are handled whole, each
within its row. Other columns of the input are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_mask(text: Column) -> Column:
    """The bits of the filters that need the text alone: 1 few words, 2 few distinct words, 4 many capitals, 8 symbols. ``text``
    isn't null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    counts = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("d"))
    by_words = F.when(counts["n"] < MIN_WORDS, 1).otherwise(0) + F.when(counts["d"].cast("long") * 100 < counts["n"].cast("long") * DISTINCT_PERCENT, 2).otherwise(0)
    return by_words + F.when(capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def cells(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part with each mask of failures, and how many of them are labelled so."""
    text = F.coalesce(field(text_col), F.lit(""))
    rows = df.select(field(id_col).alias("id"), F.coalesce(field(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_mask(text).alias("own"))
    rows = rows.groupBy("id", "digest", "part", "own").agg(F.count("*").alias("n"))
    marks = labels.select(field(id_col).alias("id"), (field(good_col) == 1).alias("good"), (field(toxic_col) == 1).alias("toxic")).where("id IS NOT NULL AND (good OR toxic)")
    marks = marks.groupBy("id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    known = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # ids are distinct within a digest, part and pair of marks, so the least one's count comes with it
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = known.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    kept = F.col("nameless") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    halves = groups.withColumn("kept", kept).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("kept")).alias("n")))).alias("h"))
    return halves.groupBy("part", F.col("h.mask").alias("mask")).agg(
        F.sum("h.n").alias("n"), F.sum(F.when(F.col("good"), F.col("h.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("h.n")).otherwise(0)).alias("toxic")
    )


def orders_of(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from (part, mask, n, good, toxic); parts have 32 cells at most."""
    held = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = held.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bits = lambda letters: f"aggregate(filter(split({letters}, ''), x -> x <> ''), 0, (a, x) -> a | shiftleft(1, ascii(x) - 65))"
    steps = steps.withColumns({"bit": F.expr(bits("substring(filter_order, step, 1)")), "before": F.expr(bits("substring(filter_order, 1, step - 1)"))})

    def total(condition: str, value: str = "c.n") -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {condition}), 0L, (a, c) -> a + {value})")

    removed = "(c.mask & before) = 0 AND (c.mask & bit) <> 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("(c.mask & (before | bit)) = 0").alias("kept"),
        total(removed).alias("removed"),
        total("(c.mask & before) <> 0 AND (c.mask & bit) <> 0").alias("redundant"),
        total("c.mask = bit").alias("unique_fails"),
        total(removed, "c.good").alias("good_lost"),
        total(removed, "c.toxic").alias("toxic_lost"),
        F.col("bit"),
    )


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: for each part, all
    orders and steps."""
    rows = orders_of(cells(df, labels, id_col, text_col, part_col))
    # 600 rows a part, whatever the table's size
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
counted AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS caps, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, (CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * caps > {CAPITAL_PERCENT} * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM counted LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM masks GROUP BY part, mask),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l) JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::BIGINT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
tallies AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER ((mask & (before | bit)) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER ((mask & before) <> 0 AND (mask & bit) <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER ((mask & before) = 0 AND (mask & bit) <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM tallies
"""
