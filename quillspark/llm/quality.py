"""Quality rules with risk-controlled thresholds, in DataFrame operations alone.

Each rule rejects a text whose signal is above a cutoff. Cutoffs are fixed beforehand and never fitted, so all labelled rows
are a holdout for them. In each stratum the cutoffs of a rule are tested from the mildest on: among labelled good rows, the
exact binomial tail gives the chance of so few false rejections if their true rate were the rule's share of ``risk``; testing
stops at the first cutoff that isn't significant (a fixed sequence, which needs no correction within a rule), and the level is
divided by the number of strata times rules (Bonferroni). So with confidence ``1 - delta`` no stratum loses more than ``risk``
of its good rows to all rules together. Of the certified cutoffs the strictest counts if it rejects at least ``use`` of the
labelled bad rows; otherwise, or without enough labels, the rule is off in that stratum.

Null and empty texts have no words and fail the base rule. A null stratum is a stratum of its own. Labels that repeat an id
count once, as good if any is good; labels without a row and rows without a label take no part in the tests. Repeated rows
are judged each for itself. Very long texts are counted whole, within their row; other columns are not read. An empty table gives an empty one; without labels only the base rule holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import field, small, staged

#: Signals and their cutoffs, from the mildest to the strictest.
RULES = {
    "symbols_per_word": (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1),
    "repeated_words": (0.48, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "repeated_lines": (0.9, 0.7, 0.5, 0.3, 0.2, 0.1),
    "chars_per_word": (30.0, 20.0, 15.0, 12.0, 10.0, 9.0),
    "short_words": (-1.2, -1.6, -2.0, -2.5, -3.0, -3.5),
}
RISK, DELTA, USE = 0.02, 0.05, 0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Threshold tables of at most so many strata are broadcast; larger ones are joined by a shuffle.
STRATA = 10_000

SPACE = r"[\\x20\\x09-\\x0D]"


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words of ``text``. The
    steps stand in projections of their own, so that what a lambda refers to is a column and computed once. Windows of
    three words are compared by 64-bit hash within their text."""
    own = ["_t", "_w", "_l", "_h", "_s"]
    out = df.withColumn("_t", F.coalesce(text, F.lit("")))
    out = out.withColumn("_w", F.expr(f"filter(split(_t, '{SPACE}+'), x -> x <> '')"))
    out = out.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace("_t", r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.expr("CASE WHEN size(_w) > 2 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END"),
        }
    )
    # only texts with a window twice go on to the places
    out = out.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i))) END"))
    places = "filter(transform(_s, (x, k) -> CASE WHEN (k > 0 AND _s[k - 1].h = x.h) OR (k + 1 < size(_s) AND _s[k + 1].h = x.h) THEN x.i END), x -> x IS NOT NULL)"
    out = out.withColumn("n_repeat_words", F.expr(f"CASE WHEN _s IS NULL THEN 0L ELSE cast(size(array_distinct(flatten(transform({places}, x -> array(x, x + 1, x + 2))))) AS long) END"))
    return out.drop(*own)


def with_signals(df: DataFrame) -> DataFrame:
    """Adds base_failed and the rules' signals to what with_counts gives; a text without words has signal 0 everywhere but in
    none above a cutoff."""
    n = F.col("n_words")
    per = lambda c, of: F.when(of > 0, F.col(c) / of).otherwise(0.0)
    return df.withColumns(
        {
            "base_failed": (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT),
            "symbols_per_word": per("n_symbols", n),
            "repeated_words": per("n_repeat_words", n),
            "repeated_lines": per("n_dup_lines", F.col("n_lines")),
            "chars_per_word": per("word_chars", n),
            "short_words": F.when(n > 0, -per("word_chars", n)).otherwise(F.lit(-1000.0)),
        }
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Bin(n, p), summed in logarithms term by term; 1 where k is above the mean, which decides nothing."""
    q = f"(ln({p!r}D) - ln(1D - {p!r}D))"
    body = (
        f"exp(aggregate(CASE WHEN k >= 1 THEN sequence(1L, k) ELSE array() END, named_struct('t', n * ln(1D - {p!r}D), 's', n * ln(1D - {p!r}D)), "
        f"(a, i) -> named_struct('t', a.t + ln((n - i + 1D) / i) + {q}, 's', "
        f"greatest(a.s, a.t + ln((n - i + 1D) / i) + {q}) + log1p(exp(-abs(a.s - (a.t + ln((n - i + 1D) / i) + {q}))))), a -> a.s))"
    )
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.expr(body))


def thresholds(signals: DataFrame, labels: DataFrame, stratum: str, rules: dict = RULES, risk: float = RISK, delta: float = DELTA, use: float = USE, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, one column for each rule: its cutoff or null) for the strata in which a rule is on. ``signals`` has id_col,
    ``stratum`` and the rules' signals of rows that the base rule keeps."""
    marks = labels.select(field(id_col).alias("_id"), (field(label_col) > 0).cast("int").alias("_good")).groupBy("_id").agg(F.max("_good").alias("_good"))
    known = signals.join(marks, field(id_col) == F.col("_id")).where("_good IS NOT NULL")
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), sum((field(r) > c).cast("int") for c in cuts).alias("passed")) for r, cuts in rules.items()])
    # how many cutoffs of each rule a row is above: one short row for each stratum, rule and number
    tally = (
        known.select(field(stratum).alias("stratum"), "_good", F.explode(pairs).alias("p"))
        .groupBy("stratum", "p.rule", "p.passed")
        .agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad"))
    )
    cuts = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(j).alias("j"), F.lit(float(c)).alias("cut")) for r, cs in rules.items() for j, c in enumerate(cs)])
    whole = Window.partitionBy("stratum", "rule")
    cells = (
        tally.withColumn("n_good", F.sum("good").over(whole))
        .withColumn("n_bad", F.sum("bad").over(whole))
        .withColumn("c", F.explode(F.filter(cuts, lambda c: c["r"] == F.col("rule"))))
        .groupBy("stratum", "rule", "n_good", "n_bad", F.col("c.j").alias("j"), F.col("c.cut").alias("cut"))
        .agg(F.sum(F.when(F.col("passed") > F.col("c.j"), F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(F.col("passed") > F.col("c.j"), F.col("bad")).otherwise(0)).alias("caught"))
    )
    cells = staged(cells, "quality-cells")
    n_strata = cells.select("stratum").distinct().count()
    level = delta / max(1, n_strata * len(rules))
    sure = cells.select("*", F.col("k").cast("long").alias("_k"), F.col("n_good").cast("double").alias("_n")).select("stratum", "rule", "j", "cut", "caught", "n_bad", F.col("_k").alias("k"), F.col("_n").alias("n"))
    sure = sure.withColumn("significant", binomial_tail(F.col("k"), F.col("n"), risk / len(rules)) <= F.lit(level))
    in_turn = Window.partitionBy("stratum", "rule").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    kept = sure.withColumn("certified", F.min(F.col("significant").cast("int")).over(in_turn) == 1).where("certified")
    best = kept.groupBy("stratum", "rule").agg(F.max(F.struct("j", "cut", "caught", "n_bad")).alias("b")).where((F.col("b.n_bad") > 0) & (F.col("b.caught") >= F.col("b.n_bad") * use))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("b.cut"))).alias(f"cut_{r}") for r in rules])


def with_verdict(signals: DataFrame, cutoffs: DataFrame, stratum: str, rules: dict = RULES) -> DataFrame:
    """Adds kept: not base_failed and no signal above its stratum's cutoff."""
    cuts = small(staged(cutoffs.withColumnRenamed("stratum", "_stratum"), "quality-cutoffs"), STRATA)
    joined = signals.join(cuts, field(stratum).eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(field(r) > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum", *[f"cut_{r}" for r in rules])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row. Texts are read once: what the rules need of them is a narrow
    table in the shared folder."""
    counted = with_counts(df.select(field(id_col).alias("doc_id"), field(stratum_col).alias("stratum"), field(text_col).alias("text")), F.col("text")).drop("text")
    table = staged(counted, "quality-counts")
    signals = with_signals(table)
    cutoffs = thresholds(signals.where("NOT base_failed"), labels.withColumnRenamed(id_col, "doc_id"), "stratum", label_col=label_col)
    return with_verdict(signals, cutoffs, "stratum").select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """The rows of ``df``, with all their columns, that judge would keep. The rows and their counts are written to the shared
    folder once, so no text is counted twice or shuffled."""
    columns = df.columns
    whole = staged(with_counts(df.select(F.struct(*[field(c) for c in columns]).alias("row"), field(id_col).alias("doc_id"), field(stratum_col).alias("stratum")), F.col("row")[text_col]), "quality-rows")
    signals = with_signals(whole)
    cutoffs = thresholds(signals.where("NOT base_failed"), labels.withColumnRenamed(id_col, "doc_id"), "stratum", label_col=label_col)
    return with_verdict(signals, cutoffs, "stratum").where("kept").select("row.*")


def oracle(rules: dict = RULES, risk: float = RISK, delta: float = DELTA, use: float = USE) -> str:
    """DuckDB SQL for the rows of judge over documents and labels; the binomial tail comes from gamma functions."""
    p = risk / len(rules)
    cuts = ", ".join(f"('{r}', {j}, {float(c)!r}::DOUBLE)" for r, cs in rules.items() for j, c in enumerate(cs))
    tail = f"CASE WHEN k > n * {p!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) END"
    per_rule = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r}::DOUBLE AS value FROM signals" for r in rules)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
windows AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY row),
counts AS (SELECT row, doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeats USING (row)),
all_signals AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeated_words,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS repeated_lines, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS chars_per_word,
  CASE WHEN n_words > 0 THEN -(word_chars / n_words) ELSE -1000 END AS short_words FROM counts),
signals AS (SELECT * FROM all_signals WHERE NOT base_failed),
marks AS (SELECT doc_id, max((quality > 0)::INT) AS good FROM labels GROUP BY doc_id),
valued AS (SELECT v.stratum, v.rule, v.value, m.good FROM ({per_rule}) v JOIN marks m USING (doc_id) WHERE m.good IS NOT NULL),
cuts(rule, j, cut) AS (VALUES {cuts}),
cells AS (SELECT stratum, rule, j, cut, sum(good)::BIGINT AS n, sum(1 - good)::BIGINT AS n_bad, sum(good * (value > cut)::INT)::BIGINT AS k, sum((1 - good) * (value > cut)::INT)::BIGINT AS caught FROM valued JOIN cuts USING (rule) GROUP BY ALL),
tested AS (SELECT *, ({tail}) <= {delta!r} / greatest(1, (SELECT count(*) FROM (SELECT DISTINCT stratum FROM cells)) * {len(rules)}) AS significant FROM cells),
certified AS (SELECT * FROM (SELECT *, bool_and(significant) OVER (PARTITION BY stratum, rule ORDER BY j) AS ok FROM tested) WHERE ok),
best AS (SELECT stratum, rule, arg_max(cut, j) AS cut FROM certified GROUP BY stratum, rule HAVING arg_max(n_bad, j) > 0 AND arg_max(caught, j) >= arg_max(n_bad, j) * {use!r}),
rejected AS (SELECT DISTINCT row FROM ({per_rule.replace("SELECT doc_id, stratum,", "SELECT row, stratum,")}) v JOIN best b ON v.rule = b.rule AND v.stratum IS NOT DISTINCT FROM b.stratum AND v.value > b.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND row NOT IN (SELECT row FROM rejected) AS kept FROM all_signals
"""
