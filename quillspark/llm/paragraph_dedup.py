"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines of ``MIN_WORDS`` words or more and, since a repeated passage may stand inside longer lines, windows of
``SPAN`` words at content-defined places: of any ``GAP`` consecutive places the one of least hash, so two copies of a passage of
``SPAN + GAP - 1`` words (39) share a window wherever they stand.

Lines with the same words are one class at once. Different lines meet in MinHash buckets (bands tuned by ``tuned_bands`` for
recall at the threshold), are compared with the bucket's pivot by exact Jaccard similarity of five-word shingles, and linked
from 3/4 on. Pairs that no pivot links are found by the exact second step of ``ngram_join``: groups of bounded size, asked by
shared prefix tokens, of other components alone. Components of the links are clusters, those of all pairs of different lines.
Of a cluster the occurrence with the least id and place stays.

A window that doesn't stand in a line to be removed is held against the place before it in its document, or else the first and the
second place of its class. Windows of one document that lie equally far from such places
in one other document are one run as far as they adjoin. A run is then widened to both sides over at most ``REACH`` words
that its first place has too: to where matches less ``MISS`` for each other word add up to most, so a changed word inside a
passage doesn't end it while four fifths of what is added agree at least. Runs of ``MIN_RUN`` words or more count.

What is removed is each line of a cluster but its first, and each run but its first place. Words are what stands between spaces and
the controls 9 to 13, A-Z lower-cased. Null and empty texts have no paragraphs. Rows with a null id take no part; rows that
repeat an id and place count as one occurrence. Very long texts are read whole. Extra columns of any name take no part.
Nothing is found in an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, field, id_and_bytes, map_texts, sliced, small, small_batches, staged
from .ngram_join import PART_ROWS, ROW, WORDS, Shingler, bridged, distinct, heavy_tokens, mixed, packed_prefixes, prefix, similar

MIN_WORDS, SPAN, GAP = 25, 20, 20
REACH, MISS, MIN_RUN = 48, 4, 40
THRESHOLD, RECALL, MOST_ROWS = 0.75, 0.99, 2
#: Lines in a group of the second step: they are short, so a group has about as many words as one of documents.
CAP = 1024
#: One text in so many tells which tokens are frequent; any order of tokens gives the same links.
SAMPLE = 32
#: Tables of at most so many rows (keys, nodes) are broadcast; larger ones are joined by a shuffle.
SMALL = 1_000_000
#: Tables of lists of at most so many rows are.
LISTS = 250_000


def tuned_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_rows: int = MOST_ROWS) -> tuple[int, int]:
    """(bands, rows): the most rows, up to ``most_rows``, and the fewest bands by which a pair at the threshold collides with
    at least the asked chance, of those with the fewest minima."""
    best = None
    for rows in range(1, most_rows + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if best is None or bands <= 2 * best[0]:
            best = (bands, rows)
    return best


BANDS, ROWS = tuned_bands()
_A = mixed(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def places(words: np.ndarray) -> np.ndarray:
    """Where windows start: of each GAP consecutive places the one of least hash, the last of equals."""
    n = len(words) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = mixed(words[:n] * np.uint64(0x9E3779B97F4A7C15) + words[1 : n + 1])
    if n <= GAP:
        return np.array([n - 1 - int(g[::-1].argmin())])
    view = np.lib.stride_tricks.sliding_window_view(g[::-1], GAP)
    return np.unique(n - 1 - (view.argmin(axis=1) + np.arange(len(view))))


#: Odd multipliers and their inverses modulo 2**64.
_BASES = [(b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def window_keys(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit digests of the windows at ``at``, from sums of powers that are taken once. Should two windows share one by chance, they
    don't go on alike, so what they give is too short to count."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k, (b, inverse) in enumerate(_BASES):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), b, np.uint64)]), dtype=np.uint64)
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), inverse, np.uint64)]), dtype=np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words + np.uint64(k)) * power[:-1], dtype=np.uint64)])
            out = mixed(out + (sums[at + SPAN] - sums[at]) * back[at])
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles at each place, in order."""
    h = np.full(max(0, len(words) - WORDS + 1), WORDS, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)])
    return h


def lines_of(text: bytes) -> list[list[bytes]]:
    return [line.split() for line in text.split(b"\n")]


def hashed(shingle: Shingler, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: the hashes of all their words, where each text begins among them and how many it has; and of the lines of
    MIN_WORDS words or more where they begin, how many words they have, and of which text they are."""
    each = [shingle.words(t) for t in texts]
    size = np.array(list(map(len, each)), np.int64)
    cut = [list(map(len, lines_of(t))) for t in texts]
    length = np.array([n for c in cut for n in c], np.int64)
    start = np.cumsum(length) - length
    of = np.repeat(np.arange(len(texts)), list(map(len, cut)))
    counts = length >= MIN_WORDS
    return np.concatenate([*each, np.zeros(0, np.uint64)]), np.cumsum(size) - size, size, start[counts], length[counts], of[counts]


def frequent_order(texts: DataFrame) -> np.ndarray:
    """Frequent tokens of all values, for ``lines``: what many lines share would else stand before what a line has alone."""
    return heavy_tokens(texts, texts.count(), SAMPLE, (1 << 64) - 1)


def lines(texts: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(doc_id, start, n, key, size, prefix, least, b0 ...) of the lines that count: place and number of words, digest of its words, number
    of different shingles, prefix of them (those in ``heavy`` come last), least minimum and band keys. Hashes are taken over all
    texts of a batch at once."""
    names = ["least", *(f"b{k}" for k in range(BANDS))]
    order = np.argsort(heavy, kind="stable")
    shared = texts.sparkSession.sparkContext.broadcast((heavy[order], order))

    def make():
        shingle = Shingler()
        common, ranks = shared.value

        def work(ids: list, texts: list[bytes]) -> dict:
            words, base, _, start, length, of = hashed(shingle, texts)
            grams, raw = shingles(words), words.tobytes()
            keys, different, first_tokens, hashes = [], [], [], []
            for a, n in zip(start.tolist(), length.tolist(), strict=True):
                keys.append(xxhash.xxh3_128_digest(raw[8 * a : 8 * (a + n)]))
                hashes.append(grams[a : a + n - WORDS + 1])
                tokens = distinct(hashes[-1])
                different.append(len(tokens))
                first_tokens.append(prefix(tokens, common, ranks).tobytes())
            bands = np.zeros((1 + BANDS, len(start)), np.int64)
            if len(start):
                every, sizes = np.concatenate(hashes), length - WORDS + 1
                first = np.cumsum(sizes) - sizes
                with np.errstate(over="ignore"):
                    for b in range(BANDS):
                        sig = np.full(len(start), b, np.uint64)
                        for r in range(ROWS):
                            least = np.minimum.reduceat(every * _A[b * ROWS + r], first)
                            if b == r == 0:
                                bands[0] = least.view(np.int64)
                            sig = mixed(sig * np.uint64(0x9E3779B97F4A7C15) + least)
                        bands[1 + b] = sig.view(np.int64)
            out: dict = {"doc_id": pa.array(np.array(ids, np.int64)[of]), "start": pa.array(start - base[of]), "n": pa.array(length), "key": pa.array(keys, pa.binary()), "size": pa.array(different, pa.int64()), "prefix": pa.array(first_tokens, pa.binary())}
            return out | {name: pa.array(bands[b]) for b, name in enumerate(names)}

        return work

    return map_texts(texts, "doc_id long, start long, n long, key binary, size long, prefix binary, " + ", ".join(f"{b} long" for b in names), make)


def places_of(texts: DataFrame) -> DataFrame:
    """(doc_id, start, n, key, window, line) of the lines that count and of the windows: place; of a line its number of words and the digest of
    them (both null for a window); of a window its digest and the start of the line that it lies in wholly (-1: none that counts)."""

    def make():
        shingle = Shingler()

        def work(ids: list, texts: list[bytes]) -> dict:
            words, base, size, start, length, of = hashed(shingle, texts)
            raw = words.tobytes()
            keys = [xxhash.xxh3_128_digest(raw[8 * a : 8 * (a + n)]) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
            at = [b + places(words[b : b + n]) for b, n in zip(base.tolist(), size.tolist(), strict=True)]
            text_of = np.repeat(np.arange(len(texts)), list(map(len, at)))
            at = np.concatenate([*at, np.zeros(0, np.int64)])
            line = np.full(len(at), -1)
            if len(start):
                held = np.searchsorted(start, at, "right") - 1
                inside = (held >= 0) & (at + SPAN <= start[held] + length[held])
                line[inside] = (start[held] - base[text_of])[inside]
            doc, m, w = np.array(ids, np.int64), len(start), len(at)
            return {
                "doc_id": pa.array(np.concatenate([doc[of], doc[text_of]])),
                "start": pa.array(np.concatenate([start - base[of], at - base[text_of]])),
                "n": pa.concat_arrays([pa.array(length), pa.nulls(w, pa.int64())]),
                "key": pa.concat_arrays([pa.array(keys, pa.binary()), pa.nulls(w, pa.binary())]),
                "window": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(window_keys(words, at).view(np.int64))]),
                "line": pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(line)]),
            }

        return work

    return map_texts(texts, "doc_id long, start long, n long, key binary, window long, line long", make)


def line_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens): the shingle set of each wanted line (doc_id, start, n, node)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "node")).alias("lines"))
    rows = texts.join(small(lists, LISTS), "doc_id").select("text", "lines")
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in sliced(batches, "text"):
            nodes, tokens = [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                words = shingle.words(text or b"")
                for x in lines:
                    nodes.append(x["node"])
                    tokens.append(distinct(shingles(words[x["start"] : x["start"] + x["n"]])).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    return rows.mapInArrow(run, "node long, tokens binary")


def prefix_tokens(lines: DataFrame) -> DataFrame:
    """The prefixes of the lines (node, size, prefix), packed."""
    small_batches(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            made = packed_prefixes([np.frombuffer(x, np.uint64) for x in tokens], np.array(nodes, np.int64), np.array(sizes, np.int64))
            out = pa.RecordBatch.from_pydict(made)
            for at in range(0, out.num_rows, 1 << 10):
                yield out.slice(at, 1 << 10)

        nodes, sizes, tokens = [], [], []
        for batch in batches:
            for column, held in (("node", nodes), ("size", sizes), ("prefix", tokens)):
                held += batch.column(column).to_pylist()
            if sum(map(len, tokens)) >= 8 * PART_ROWS:
                yield from rows()
                nodes, sizes, tokens = [], [], []
        if tokens:
            yield from rows()

    return lines.select("node", "size", "prefix").mapInArrow(run, "part int, " + ", ".join(f"{c} binary" for c in ROW))


def repeated_windows(windows: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc_id, start, key, fdoc, fstart): windows (doc_id, start, key, line) of all texts that stand elsewhere too, beside earlier places.
    Those inside the lines ``removed`` (doc_id, start) go with these and ask no more."""
    place = F.struct("doc_id", "start")
    seen = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    seen = staged(seen.select("key", F.col("first.doc_id").alias("fdoc"), F.col("first.start").alias("fstart")), "windows-seen")
    other = lambda df: df.where("doc_id <> fdoc OR start <> fstart")
    hits = staged(other(windows.join(small(seen, SMALL), "key")), "windows-hits")
    every = hits
    free = hits.join(small(removed.select("doc_id", F.col("start").alias("line")), SMALL), ["doc_id", "line"], "left_anti").drop("line")
    # a window that its document has before is held against that place, so that what repeats at one distance is one run however
    # often it does; the first of a document against the first and the second place of all: a copy may go on where one of them doesn't
    before = F.lag("start").over(Window.partitionBy("doc_id", "key").orderBy("start"))
    hits = staged(free.distinct().withColumn("before", before), "windows-free")
    dropped(every)
    own = hits.where("before IS NOT NULL").select("doc_id", "start", "key", F.col("doc_id").alias("fdoc"), F.col("before").alias("fstart"))
    alone = hits.where("before IS NULL").drop("before")
    second = staged(hits.groupBy("key").agg(F.min(place).alias("second")).select("key", F.col("second.doc_id").alias("fdoc"), F.col("second.start").alias("fstart")), "windows-second")
    dropped(seen)
    return own.unionByName(alone).unionByName(other(alone.drop("fdoc", "fstart").join(small(second, SMALL), "key").select(*alone.columns)))


def runs_of(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, start, end, fdoc, fstart, class): runs of words and the earlier places that have them too, from repeated_windows."""
    # windows on one diagonal (a document, another, how far apart): a document has no more of them than words
    lines = hits.groupBy("doc_id", "fdoc", (F.col("start") - F.col("fstart")).alias("apart")).agg(F.sort_array(F.collect_set(F.struct("start", F.xxhash64("key").alias("class")))).alias("w"))
    small_batches(texts.sparkSession)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("w")
            many = pa.compute.list_value_length(column).to_numpy()
            flat = column.flatten()
            start, kind = (flat.field(c).to_numpy() for c in ("start", "class"))
            line = np.repeat(np.arange(len(many)), many)
            if not len(start):
                continue
            new = np.r_[True, (line[1:] != line[:-1]) | (start[1:] > start[:-1] + SPAN)]
            at = np.flatnonzero(new)
            last = np.r_[at[1:], len(start)] - 1
            doc, fdoc, apart = (batch.column(c).to_numpy()[line[at]] for c in ("doc_id", "fdoc", "apart"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, start[at], start[last] + SPAN, fdoc, start[at] - apart, np.minimum.reduceat(kind, at))], names=["doc_id", "start", "end", "fdoc", "fstart", "class"])

    found = staged(lines.mapInArrow(chained, "doc_id long, start long, end long, fdoc long, fstart long, class long"), "windows-runs")
    return widened(texts, found)


def contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, side, at, words): for each (doc_id, side, at) up to REACH words before ``at`` (side -1, the nearest first) or from it on
    (side 1), as 32-bit hashes."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("side", "at")).alias("ends"))
    rows = texts.join(small(lists, LISTS), "doc_id").select("doc_id", "text", "ends")
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in sliced(batches, "text"):
            ids, sides, ats, out = [], [], [], []
            for doc, text, ends in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ends"), strict=True):
                words = shingle.words(text or b"").astype(np.uint32)
                flat = ends.values
                side, at = (flat.field(c).to_numpy() for c in ("side", "at"))
                ids.append(np.full(len(side), doc))
                sides.append(side)
                ats.append(at)
                out += [(words[max(0, a - REACH) : a][::-1] if s < 0 else words[a : a + REACH]).tobytes() for s, a in zip(side.tolist(), at.tolist(), strict=True)]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sides)), pa.array(np.concatenate(ats)), pa.array(out, pa.binary())], names=["doc_id", "side", "at", "words"])

    return rows.mapInArrow(run, "doc_id long, side int, at long, words binary").dropDuplicates(["doc_id", "side", "at"])


def extension(a: bytes, b: bytes) -> int:
    """How many words to go on: to where equal ones less MISS for each other one add up to most, the nearest of such."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    n = min(len(x), len(y))
    score = np.cumsum(np.where(x[:n] == y[:n], 1, -MISS))
    return int(score.argmax()) + 1 if n and score.max() > 0 else 0


def widened(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with both ends moved out as far as extension goes; those of less than MIN_RUN words go."""
    length = F.col("end") - F.col("start")
    ends = F.array(
        F.struct(F.lit(-1).alias("side"), F.col("start").alias("at"), F.col("fstart").alias("fat")),
        F.struct(F.lit(1).alias("side"), F.col("end").alias("at"), (F.col("fstart") + length).alias("fat")),
    )
    sides = staged(runs.select("*", F.explode(ends).alias("e")).select(*runs.columns, "e.*"), "runs-ends")
    wanted = sides.select("doc_id", "side", "at").unionByName(sides.select(F.col("fdoc").alias("doc_id"), "side", F.col("fat").alias("at"))).distinct()
    near = staged(contexts(texts, staged(wanted, "runs-wanted")), "runs-contexts")
    both = sides.join(near.withColumnRenamed("words", "own"), ["doc_id", "side", "at"])
    first = near.select(F.col("doc_id").alias("fdoc"), "side", F.col("at").alias("fat"), F.col("words").alias("theirs"))
    both = both.join(first, ["fdoc", "side", "fat"]).select(*runs.columns, "side", "own", "theirs")
    small_batches(texts.sparkSession)
    names = runs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = [extension(a, b) for a, b in zip(batch.column("own").to_pylist(), batch.column("theirs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*names, "side")] + [pa.array(more, pa.int64())], names=[*names, "side", "more"])

    schema = ", ".join(f"{c} {t}" for c, t in runs.dtypes) + ", side int, more long"
    moved = both.mapInArrow(run, schema).groupBy(*runs.columns).agg(*[F.max(F.when(F.col("side") == s, F.col("more")).otherwise(0)).alias(c) for s, c in ((-1, "left"), (1, "right"))])
    out = moved.select("doc_id", (F.col("start") - F.col("left")).alias("start"), (F.col("end") + F.col("right")).alias("end"), "fdoc", (F.col("fstart") - F.col("left")).alias("fstart"), "class")
    out = staged(out.where(F.col("end") - F.col("start") >= MIN_RUN), "runs-widened")
    for x in (sides, near, runs):
        dropped(x)
    return out


def near_lines(texts: DataFrame, lines: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, component) of the classes of lines that are linked, from the classes (node, doc_id, start, n: any one place, and
    size, prefix, least) and the (bucket, node) of all lines.

    A node is turned by its bucket (exclusive or), so that the least of a bucket, its pivot, is another in each; least and
    greatest combine before the shuffle, copies of a line being one node, and only buckets where they differ are joined."""
    turned = F.col("node").bitwiseXOR(F.col("bucket"))
    met = buckets.groupBy("bucket").agg(F.min(turned).alias("lo"), F.max(turned).alias("hi")).where("lo <> hi")
    met = staged(met.select("bucket", F.col("lo").bitwiseXOR(F.col("bucket")).alias("pivot")), "lines-met")
    pairs = buckets.join(small(met, SMALL), "bucket").where("node <> pivot").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    pairs = staged(pairs, "lines-pairs")
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = staged(line_sets(texts, lines.select("node", "doc_id", "start", "n").join(small(staged(involved, "lines-involved"), SMALL), "node")).groupBy("node").agg(F.first("tokens").alias("tokens")), "lines-sets")
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("sb")), "b")
    first = staged(components(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "lines-components"), "lines-component")
    dropped(sets)

    # pairs that no pivot links
    ranks = first.join(first.groupBy("component").agg(F.count("*").alias("csize")), "component").select("node", F.struct("csize", F.col("component").alias("comp")).alias("rank"))
    alone = F.struct(F.lit(1).cast("long").alias("csize"), F.col("node").alias("comp"))
    ranked = lines.join(ranks, "node", "left").select(F.col("node").alias("rep"), F.col("size").alias("n"), F.coalesce("rank", alone).alias("rank"), F.xxhash64(F.when(F.col("rank").isNull(), F.col("least")), "rank.comp").alias("bucket"))
    ranked = staged(ranked, "lines-ranked")

    def sets_of_reps(reps: DataFrame) -> DataFrame:
        wanted = lines.select("node", "doc_id", "start", "n").join(small(reps.withColumnRenamed("rep", "node"), SMALL), "node")
        return line_sets(texts, wanted).groupBy(F.col("node").alias("rep")).agg(F.first("tokens").alias("tokens"))

    over = bridged(ranked, prefix_tokens(lines), sets_of_reps, CAP)
    joined = ranked.select("rep", "rank.*").join(over, "comp", "left").where("csize > 1 OR above IS NOT NULL")
    return joined.select(F.col("rep").alias("node"), F.coalesce("above", "comp").alias("component"))


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, class_id, removed): runs of words, end exclusive, that stand elsewhere too.
    ``removed`` is false where they are the first of their kind and stay; class_id is the least cluster in the run."""
    texts = id_and_bytes(df, id_col, text_col).where("doc_id IS NOT NULL")
    # texts are read twice, for what tells lines apart and for all places: while lines are linked, places take no room
    place = F.xxhash64("doc_id", "start")
    elsewhere = F.min(place) != F.max(place)
    # one row for each different line; its place is any one occurrence's, to read its words again
    made = ["doc_id", "start", "n", "size", "prefix", "least", *(f"b{k}" for k in range(BANDS))]
    kinds = lines(texts, frequent_order(texts)).groupBy("key").agg(elsewhere.alias("repeats"), *[F.first(c).alias(c) for c in made])
    kinds = staged(kinds.withColumn("node", F.xxhash64("key")), "lines")
    buckets = kinds.select("node", F.explode(F.array(*[F.col(f"b{k}") for k in range(BANDS)])).alias("bucket"))
    near = staged(near_lines(texts, kinds, buckets), "lines-near")
    linked = kinds.join(near, "node", "left").where("repeats OR component IS NOT NULL").select("key", F.coalesce("component", "node").alias("class"))
    linked = staged(linked, "lines-linked")
    dropped(kinds)
    every = staged(places_of(texts), "paragraphs")
    whole = every.where("key IS NOT NULL").select("doc_id", "start", "n", "key")
    found = staged(whole.join(small(linked, SMALL), "key").select("doc_id", "start", "n", "class").distinct(), "paragraphs-found")
    first = staged(found.groupBy("class").agg(F.min(F.struct("doc_id", "start")).alias("first")), "paragraphs-first")
    marked = found.join(small(first, SMALL), "class").select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"), "class", (F.struct("doc_id", "start") != F.col("first")).alias("removed"))
    marked = staged(marked, "paragraphs-marked")
    for x in (linked, near, found):
        dropped(x)
    hits = staged(repeated_windows(every.where("key IS NULL").select("doc_id", "start", F.col("window").alias("key"), "line"), marked.where("removed")), "windows-repeated")
    dropped(every)  # before texts are dealt for what is left
    runs = runs_of(texts, hits)
    copies = runs.select("doc_id", "start", "end", "class", F.lit(True).alias("removed"))
    stay = runs.groupBy(F.col("fdoc").alias("doc_id"), F.col("fstart").alias("start"), (F.col("fstart") + F.col("end") - F.col("start")).alias("end")).agg(F.min("class").alias("class")).withColumn("removed", F.lit(False))
    marked = marked.unionByName(copies).unionByName(stay)
    # runs: what overlaps or adjoins
    in_doc = Window.partitionBy("doc_id", "removed").orderBy("start", "end")
    before = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    joined = marked.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("doc_id", "removed", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("class").alias("class_id"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "class_id", "removed")


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``runs`` and the white space after them."""
    gone = np.zeros(max(e for _, e in runs), bool)
    for s, e in runs:
        gone[s:e] = True
    out, at, inside = [], 0, False
    for k, m in enumerate(WORD.finditer(text)):
        now = k < len(gone) and bool(gone[k])
        if now and not inside:
            out.append(text[at : m.start()])
        if inside and not now:
            at = m.start()
        inside = now
    return b"".join(out if inside else [*out, text[at:]])


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the runs to be removed cut from its texts; other columns and null texts as they are. Rows travel as one
    struct, so no name of a column matters."""
    runs = find_repeats(df, id_col, text_col).where("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("runs"))
    names = df.columns
    rows = df.select(field(id_col).alias("doc_id"), field(text_col).cast("binary").alias("text"), F.struct(*[field(c) for c in names if c != text_col]).alias("row"))
    joined = rows.join(small(runs, LISTS), "doc_id", "left").drop("doc_id")
    small_batches(df.sparkSession)
    rest = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = batch.column("text").to_pylist()
            new = [t if not r or t is None else cut(t, [(x["start_word"], x["end_word"]) for x in r]) for t, r in zip(texts, batch.column("runs").to_pylist(), strict=True)]
            new = [None if t is None else t.decode("utf-8", "replace") for t in new]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), batch.column("row")], names=["text", "row"])

    out = joined.mapInArrow(run, f"text string, row {rest}")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names])
