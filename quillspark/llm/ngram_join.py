"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct shingles of five words (as 64-bit hashes). Documents with equal sets are one class and need
no comparison. The join links classes whose Jaccard similarity reaches 3/4, in three steps:

1. MinHash buckets put similar classes together; each member of a bucket is compared with the bucket's two pivots alone, which
   links most large families in a number of comparisons that is linear in their size. Nothing rests on this step's recall.
2. Classes of one component, or else those that meet the same central pivot, or else of one least hash, CAP at most, form a group. The token-group matrix has a row for each token and group that holds
   it, built from prefixes: in a global order of tokens (rare ones first), two sets that are similar enough share at least
   k of their first ``n - 3/7 (n + m) + k`` tokens, with k a twentieth of the smaller set and one. A class asks the groups that
   share so many prefix tokens with it, in sets of fitting size, and hold classes that aren't in its component yet; of two
   components the smaller asks the larger. Tokens that a set has alone narrow the sizes that fit: with u of them it can share
   ``n - u`` at most, which 3/7 of both sizes must not exceed.
3. A group that qualifies is opened: if the class shares too little with the union of the group's sets, it is left;
   otherwise members are compared exactly, one link for each component being enough.

Components of the links are those of all pairs, since a pair is only left out if its ends are already connected. Token
order comes from counts over all documents (the ``HEAVY`` most frequent tokens); any order gives the same links.

Texts of fewer than five words are one shingle; null, empty and blank texts have the empty set and are linked with
nothing, as are rows whose id is null (their component is null). Rows that share an id count as one document. Repeated
rows keep a row each. Very long texts are read whole, PART bytes at a time. Other columns, of any name, are not read. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, field, id_and_bytes, map_texts, small, small_batches, staged

WORDS = 5
#: The similarity is at least NUM / DEN.
NUM, DEN = 3, 4
BANDS, ROWS = 8, 2
#: Classes in a group, and tokens of their sets (what is more by one set stands alone); queries that a task answers for a group.
CAP, CAP_TOKENS, QUERIES = 128, 1 << 20, 2048
#: Shared prefix tokens asked for: a twentieth of the smaller set and one.
SHARE = 20
HEAVY = 250_000
#: Tokens travel in parts by their first bits, so that a row has many of them; a part's rows that Python holds at once, besides lone tokens.
PART_BITS, PART_ROWS = 11, 1 << 18
#: Bits of a token that don't tell when tokens are counted: those with the other bits in common count together.
LOW_BITS = 21
#: Lists of ids of at most so many rows are broadcast; longer ones are joined by a shuffle.
SMALL = 500_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


_A = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)


#: What a byte adds to its word's hash (A-Z as a-z), and whether it ends a word.
_BYTE = mixed((np.arange(1, 257, dtype=np.uint64) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint64)) * _MIX[0])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes whose words are hashed at once; a longer word is hashed whole.
PART = 1 << 18


class Shingler:
    """Hashes of words, and sorted distinct hashes of shingles. A word's hash sums its bytes times powers of an odd number, so all
    words of a text are hashed by a few array operations."""

    def __init__(self) -> None:
        self.power = np.ones(1, np.uint64)

    def _powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 10), _MIX[1], np.uint64)]), dtype=np.uint64)
        return self.power

    def words(self, text: bytes) -> np.ndarray:
        if len(text) <= PART:
            return self._hashed(text)
        parts, at = [], 0
        while at < len(text):
            end = at + PART
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            parts.append(self._hashed(text[at:end]))
            at = end
        return np.concatenate(parts)

    def _hashed(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, np.uint8)
        letter = np.flatnonzero(~_SPACE[raw])
        if not len(letter):
            return np.zeros(0, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], np.diff(letter) > 1]))
        size = np.diff(np.concatenate([first, [len(letter)]]))
        place = np.arange(len(letter)) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_BYTE[raw[letter]] * self._powers(int(size.max()))[place], first)
            return mixed(sums + size.astype(np.uint64))

    def __call__(self, text: bytes) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        width = min(WORDS, len(w))
        h = np.full(len(w) - width + 1, width, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                h = mixed(h * _MIX[0] + w[k : len(w) - width + 1 + k])
        return distinct(h)


def distinct(tokens: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    t = np.sort(tokens)
    return t[np.concatenate([[True], t[1:] != t[:-1]])] if len(t) else t


def signature(tokens: np.ndarray) -> np.ndarray:
    """The keys of BANDS bands of ROWS minima each, then the first minimum."""
    out = np.empty(BANDS + 1, np.uint64)
    with np.errstate(over="ignore"):
        least = [(tokens * a).min() for a in _A]
        for b in range(BANDS):
            key = np.uint64(b)
            for x in least[b * ROWS : (b + 1) * ROWS]:
                key = mixed(key * _MIX[0] + x)
            out[b] = key
    out[BANDS] = least[0]
    return out.view(np.int64)


def needed(n: int) -> int:
    """Least overlap of a set of n with one that is similar to it."""
    return -(-n * NUM // DEN)


def prefix_length(n: int) -> int:
    return min(n, n - needed(n) + 1 + n // SHARE)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = overlap(a, b)
    return both * DEN >= (len(a) + len(b) - both) * NUM


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def described(texts: DataFrame) -> DataFrame:
    """(doc_id, n, key, bands, least): set size, digest of the set, MinHash bands and the first minimum; of empty sets key is null and the rest means nothing."""

    def make():
        shingle = Shingler()

        def work(ids: list, texts: list[bytes]) -> dict:
            n, keys, signed = np.zeros(len(texts), np.int64), [], np.zeros((len(texts), BANDS + 1), np.int64)
            for k, text in enumerate(texts):
                t = shingle(text)
                n[k] = len(t)
                keys.append(xxhash.xxh3_128_digest(t.tobytes()) if len(t) else None)
                if len(t):
                    signed[k] = signature(t)
            ends = np.arange(0, BANDS * len(texts) + 1, BANDS, dtype=np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed[:, :BANDS].ravel()))
            return {"doc_id": ids, "n": pa.array(n), "key": keys, "bands": bands, "least": pa.array(signed[:, BANDS])}

        return work

    return map_texts(texts, "doc_id long, n long, key binary, bands array<long>, least long", make)


def sets_of(texts: DataFrame) -> DataFrame:
    """(doc_id, tokens): the set as sorted 64-bit integers."""

    def make():
        shingle = Shingler()
        return lambda ids, texts: {"doc_id": ids, "tokens": [shingle(t).tobytes() for t in texts]}

    return map_texts(texts, "doc_id long, tokens binary", make)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar."""
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            keep = [similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def met_pivots(classes: DataFrame) -> DataFrame:
    """(rep, n, c, d): each member of a MinHash bucket beside the bucket's two pivots. ``c`` is the member whose buckets have
    most members together: in a family of variants that is the text next to the one they come from, to which members are
    closer than to each other. ``d`` is the member of least hash with the bucket, so that a family's buckets have different
    ones."""
    in_buckets = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    # aggregates by bucket are tables of their own, so that both sides of their joins are dealt anew and large buckets can be split
    met = staged(in_buckets.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "join-counts")
    in_buckets = staged(in_buckets.join(small(met, SMALL), "bucket"), "join-buckets")
    dropped(met)
    central = in_buckets.groupBy("rep").agg(F.sum("m").alias("weight"))
    weighed = F.struct("weight", "rep", "n")
    pivots = in_buckets.join(central, "rep").groupBy("bucket").agg(F.max(weighed).alias("c"), F.min_by(F.struct("rep", "n"), F.xxhash64("rep", "bucket")).alias("d"))
    out = staged(in_buckets.join(small(pivots, SMALL), "bucket").select("rep", "n", "c", "d"), "join-met")
    dropped(in_buckets)
    return out


def bucket_pairs(met: DataFrame) -> DataFrame:
    """(a, b): members of buckets with their pivots, where sizes allow a link."""
    pairs = met.select("rep", "n", F.explode(F.array(F.struct("c.rep", "c.n"), "d")).alias("p")).where(F.col("rep") != F.col("p.rep"))
    fits = F.least("n", "p.n") * DEN >= F.greatest("n", "p.n") * NUM
    return pairs.where(fits).select(F.greatest("rep", "p.rep").alias("a"), F.least("rep", "p.rep").alias("b")).distinct()


def packed(tokens: np.ndarray, **columns: np.ndarray) -> dict:
    """part and ``columns`` as bytes, a row for each part of the tokens (sorted) that has any."""
    part = tokens >> np.uint64(64 - PART_BITS)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.concatenate([at, [len(part)]])
    out = {"part": pa.array(part[at].astype(np.int32))}
    return out | {c: pa.Array.from_buffers(pa.binary(), len(at), [None, *map(pa.py_buffer, ((ends * x.itemsize).astype(np.int32), x))]) for c, x in columns.items()}


def in_parts(rows: DataFrame, work: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str, most: int = PART_ROWS, **types: type) -> DataFrame:
    """Deals what ``packed`` made by part; ``work`` gets (part, columns as arrays of ``types``), a part's in pieces of about ``most`` rows one after the other."""
    small_batches(rows.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held, n = None, [], 0
        for batch in batches:
            for part, *columns in zip(*(batch.column(c).to_pylist() for c in ("part", *types)), strict=True):
                if held and (part != now or n >= most):
                    yield now, *(np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), types.values(), strict=True))
                    held, n = [], 0
                now, n = part, n + len(columns[0]) // np.dtype(next(iter(types.values()))).itemsize
                held.append(columns)
        if held:
            yield now, *(np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), types.values(), strict=True))

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: work(pieces(batches)), schema)


def starts(x: np.ndarray) -> np.ndarray:
    """Where equal ones begin in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def frequent_keys(texts: DataFrame) -> np.ndarray:
    """Tokens without their LOW_BITS met three times or more in all texts, from the least to the most frequent. All values are counted: a
    passage that many texts share would else stand before what texts have alone."""

    def make():
        shingle = Shingler()

        def work(_: list, texts: list[bytes]) -> dict:
            t = np.concatenate([shingle(x) >> np.uint64(LOW_BITS) for x in texts] or [np.zeros(0, np.uint64)])
            t, n = np.unique(t, return_counts=True)
            return packed(t << np.uint64(LOW_BITS), key=t.astype(np.uint32), m=n.astype(np.uint16))

        return work

    def counted(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for part, key, m in pieces:
            if part != at and known is not None:
                yield kept(at, *known)
            key, m = key.astype(np.uint64), m.astype(np.int64)
            if part == at:
                key, m = np.concatenate([known[0], key]), np.concatenate([known[1], m])
            order = np.argsort(key)
            key, m = key[order], m[order]
            first = starts(key)
            at, known = part, (key[first], np.add.reduceat(m, first))
        if known is not None:
            yield kept(at, *known)

    def kept(part: int, key: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        key = key[m > 2] | np.uint64(part << (64 - PART_BITS - LOW_BITS))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(m[m > 2])], names=["token", "m"])

    rows = map_texts(texts, "part int, key binary, m binary", make)
    counts = in_parts(rows, counted, "token long, m long", key=np.uint32, m=np.uint16)
    top = counts.orderBy(F.desc("m"), "token").limit(HEAVY).collect()
    return np.array([r["token"] for r in reversed(top)], np.int64).view(np.uint64)


def heavy_tokens(texts: DataFrame, rows: int, share: int = 1, most: int = (1 << 63) - 1) -> np.ndarray:
    """Tokens up to ``most`` met three times or more in all texts (or one of ``share``), from the least to the most frequent."""
    step = max(1, min(share, rows // 10_000))

    def make():
        shingle = Shingler()

        def work(_: list, texts: list[bytes]) -> dict:
            t = np.concatenate([shingle(x) for x in texts] or [np.zeros(0, np.uint64)])
            t, n = np.unique(t[t <= np.uint64(most)], return_counts=True)
            return {"token": pa.array(t.view(np.int64)), "m": pa.array(n)}

        return work

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    counts = map_texts(sample, "token long, m long", make).groupBy("token").agg(F.sum("m").alias("m")).where("m > 2")
    top = counts.orderBy(F.desc("m"), "token").limit(HEAVY).collect()
    return np.array([r["token"] for r in reversed(top)], np.int64).view(np.uint64)


def prefix(t: np.ndarray, values: np.ndarray, ranks: np.ndarray, low_bits: int = 0) -> np.ndarray:
    """The first tokens of a sorted set: those not in ``values`` (sorted, without ``low_bits``) first, by value; then by their ``ranks``."""
    if len(values) and len(t):
        key = t >> np.uint64(low_bits)
        at = np.searchsorted(values, key)
        at[at == len(values)] = 0
        rank = np.where(values[at] == key, ranks[at] + 1, 0)
        t = t[np.argsort(rank, kind="stable")]
    return t[: prefix_length(len(t))]


#: A row of a prefix.
ROW = {"token": np.uint64, "rep": np.int64, "n": np.int32, "pos": np.int32}


def packed_prefixes(tokens: list[np.ndarray], reps: np.ndarray, sizes: np.ndarray) -> dict:
    """The columns of ROW, packed, from the first tokens of sets, their reps and their sizes."""
    many = list(map(len, tokens))
    token = np.concatenate([*tokens, np.zeros(0, np.uint64)])
    order = np.argsort(token)
    pos = np.concatenate([*(np.arange(k, dtype=np.int32) for k in many), np.zeros(0, np.int32)])
    rep, n = np.repeat(reps.astype(np.int64), many), np.repeat(sizes.astype(np.int32), many)
    return packed(token[order], token=token[order], rep=rep[order], n=n[order], pos=pos[order])


def prefixes(texts: DataFrame, keys: np.ndarray) -> DataFrame:
    """The first tokens of each set, packed: those not in ``keys`` (frequent_keys) first, by value; then by frequency."""
    order = np.argsort(keys, kind="stable")
    shared = texts.sparkSession.sparkContext.broadcast((keys[order], order))

    def make():
        shingle = Shingler()
        values, ranks = shared.value

        def work(ids: list, texts: list[bytes]) -> dict:
            sets = [shingle(text) for text in texts]
            return packed_prefixes([prefix(t, values, ranks, LOW_BITS) for t in sets], np.array(ids, np.int64), np.array(list(map(len, sets)), np.int64))

        return work

    return map_texts(texts, "part int, " + ", ".join(f"{c} binary" for c in ROW), make)


def opened(rows: DataFrame) -> DataFrame:
    """Links (a, b) from (grp, block, asks, rep, rank, tokens): within a group and block, members (asks = 0) come first; then
    each asking class is held against the union of their sets and, if that leaves room, against the members of higher rank
    (a pair: size of its component, component)."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, union = None, [], None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for grp, block, asks, rep, rank, tokens in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "asks", "rep", "rank", "tokens")), strict=True):
                if (grp, block) != at:
                    at, members, union = (grp, block), [], None
                own, rank = np.frombuffer(tokens, np.uint64), (rank["csize"], rank["comp"])
                if not asks:
                    members.append((rep, rank, own))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([t for _, _, t in members] or [own[:0]]))
                if overlap(own, union) < needed(len(own)):
                    continue
                met = set()
                for other, theirs, t in members:
                    if theirs > rank and theirs not in met and min(len(own), len(t)) * DEN >= max(len(own), len(t)) * NUM and similar(own, t):
                        met.add(theirs)
                        links.append((rep, other))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "asks").mapInArrow(run, "a long, b long")


def bridged(ranked: DataFrame, tokens: DataFrame, sets_of_reps: Callable[[DataFrame], DataFrame], cap: int = CAP) -> DataFrame:
    """(comp, above): components that links join, and the least of those joined. ``ranked`` has (rep, n, rank: size of its
    component and component, bucket: what groups are made of), ``tokens`` the prefixes (ROW, packed); ``sets_of_reps`` gives the sets
    (rep, tokens) of a table of reps. A group has about ``cap`` classes and CAP_TOKENS tokens at most."""
    chunks = ranked.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / cap, F.sum("n") / CAP_TOKENS)).alias("chunks"))
    grouped = ranked.join(small(staged(chunks, "join-chunks"), SMALL), "bucket").select("rep", F.xxhash64("bucket", F.pmod(F.xxhash64("rep"), F.col("chunks"))).alias("grp"), "rank", "n")
    grouped = staged(grouped, "join-groups")
    # tokens of one class alone link nothing
    shared = staged(in_company(tokens), "join-tokens")
    met = shared.groupBy("rep").agg(F.count("*").alias("met"))
    alone_in = F.expr(f"least(n, n - ({NUM} * n + {DEN - 1}) div {DEN} + 1 + n div {SHARE}) - met")
    reaching = grouped.join(met, "rep").withColumn("reach", F.floor((DEN * F.col("n") - (NUM + DEN) * F.greatest(alone_in, F.lit(0))) / NUM))
    held = staged(shared.join(reaching.select("rep", "grp", "rank", "reach"), "rep"), "join-held")
    dropped(shared)
    # a token counts for a pair only if it is within both prefixes that their sizes ask for; a group stands for its members'
    # best chances, so nothing is left out
    part = NUM / (NUM + DEN)
    within = F.col("n") * (1 - part + 1 / SHARE) + 1 - F.col("pos")
    matrix = held.groupBy("token", "grp").agg(F.max("rank").alias("top"), F.min("n").alias("least"), F.max("reach").alias("most"), F.max(within).alias("room"))
    fits = (F.col("top") > F.col("rank")) & (F.col("most") >= F.col("n")) & (F.col("least") <= F.col("reach"))
    near = (F.col("room") + 1e-6 > F.col("n") * part) & (within + 1e-6 > F.col("least") * part)
    ask = held.join(matrix.withColumnRenamed("grp", "into"), "token").where(fits & near)
    ask = ask.groupBy("rep", F.col("into").alias("grp")).agg(F.count("*").alias("m"), F.least(F.first("n"), F.min("least")).alias("small")).where(F.col("m") > F.floor(F.col("small") / SHARE))
    ask = staged(ask.select("rep", "grp"), "join-ask")
    dropped(held)

    # open the groups that qualify
    blocks = staged(ask.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "join-blocks")
    asking = ask.join(blocks, "grp").join(grouped.select("rep", "rank"), "rep").select("grp", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.lit(1).alias("asks"), "rep", "rank")
    inside = grouped.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("grp", "block", F.lit(0).alias("asks"), "rep", "rank")
    rows = staged(asking.unionByName(inside), "join-rows")
    involved = staged(rows.select("rep").distinct(), "join-involved")
    sets = staged(sets_of_reps(involved), "join-sets")
    links = staged(opened(rows.join(sets, "rep").select("grp", "block", "asks", "rep", "rank", "tokens")), "join-links")
    dropped(sets)

    # components of the components
    name = lambda c: grouped.select(F.col("rep").alias(c), F.col("rank.comp").alias(f"c{c}"))
    over = components(links.join(name("a"), "a").join(name("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")), "join-second")
    return over.select(F.col("node").alias("comp"), F.col("component").alias("above"))


def joined(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``df``: the size of its set and the smallest id that links reach."""
    texts = id_and_bytes(df, id_col, text_col)
    docs = staged(described(texts), "join-docs")
    known = docs.where("n > 0 AND doc_id IS NOT NULL")
    classes = staged(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("least").alias("least")), "join-classes")

    # 1: members of MinHash buckets with their pivots
    met = met_pivots(classes)
    pairs = staged(bucket_pairs(met), "join-pairs")
    homes = staged(met.groupBy("rep").agg(F.max(F.struct("c.weight", "c.rep")).alias("home")).select("rep", F.col("home.rep").alias("home")), "join-homes")
    dropped(met)
    asked = staged(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "join-asked")
    sets = staged(sets_of(texts.join(small(asked, SMALL), "doc_id", "left_semi")).distinct(), "join-sets")
    first = staged(components(verified(pairs, sets), "join-first"), "join-component")
    dropped(sets)
    sizes = first.groupBy("component").agg(F.count("*").alias("csize"))
    ranks = first.join(sizes, "component").select(F.col("node").alias("rep"), F.struct("csize", F.col("component").alias("comp")).alias("rank"))

    # 2 and 3: groups, the token-group matrix and what it opens
    alone = F.struct(F.lit(1).cast("long").alias("csize"), F.col("rep").alias("comp"))
    bucket = F.when(F.col("rank").isNotNull(), F.xxhash64(F.lit(0), "rank.comp")).when(F.col("home").isNotNull(), F.xxhash64(F.lit(1), "home")).otherwise(F.xxhash64(F.lit(2), "least"))
    ranked = classes.join(ranks, "rep", "left").join(homes, "rep", "left").select("rep", "n", F.coalesce("rank", alone).alias("rank"), bucket.alias("bucket"))
    ranked = staged(ranked, "join-ranked")
    copies = known.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_anti").select("doc_id").distinct()
    copies = staged(copies.unionByName(docs.where("n = 0 AND doc_id IS NOT NULL").select("doc_id").distinct().join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_anti")).distinct(), "join-copies")
    different = texts.where("doc_id IS NOT NULL").join(small(copies, SMALL), "doc_id", "left_anti")
    tokens = prefixes(different, frequent_keys(texts))
    over = bridged(ranked, tokens, lambda reps: sets_of(texts.join(small(reps.withColumnRenamed("rep", "doc_id"), SMALL), "doc_id", "left_semi")).distinct().withColumnRenamed("doc_id", "rep"))
    of_class = classes.select("key", "rep").join(ranked.select("rep", F.col("rank.comp").alias("comp")), "rep").join(over, "comp", "left").select("key", F.coalesce("above", "comp").alias("component_id"))
    linked = docs.where("n > 0").select("doc_id", "n", "key").join(of_class, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return linked.unionByName(docs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def in_company(tokens: DataFrame) -> DataFrame:
    """(token, rep, n, pos) of the packed rows whose token another rep has too."""

    def work(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        at = None
        for part, *piece in pieces:
            if part != at:
                at, known, lone = part, np.zeros(0, np.uint64), None
            rows = piece if lone is None else [np.concatenate(x) for x in zip(lone, piece, strict=True)]
            order = np.argsort(rows[0])
            rows = [x[order] for x in rows]
            first = starts(rows[0])
            met = (np.minimum.reduceat(rows[1], first) < np.maximum.reduceat(rows[1], first)) | np.isin(rows[0][first], known)
            keep = np.repeat(met, np.diff(np.concatenate([first, [len(order)]])))
            known, lone = np.union1d(known, rows[0][first][met]), [x[~keep] for x in rows]
            token, *rest = (x[keep] for x in rows)
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), *rest)], names=list(ROW))
            for k in range(0, out.num_rows, 1 << 14):
                yield out.slice(k, 1 << 14)

    return in_parts(tokens, work, "token long, rep long, n int, pos int", **ROW)


#: DuckDB SQL for the rows of joined over documents: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
tokens AS MATERIALIZED (SELECT rep, n, md5(t) AS t FROM (SELECT rep, n, unnest(s) AS t FROM classes)),
pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS x, b.n AS y, count(*) AS common FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep < b.rep GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * common >= 75 * (x + y - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
component AS (SELECT a AS rep, min(b) AS least FROM reached GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE least(classes.rep, coalesce(least, classes.rep)) END AS component_id
FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s) LEFT JOIN component ON component.rep = classes.rep
"""


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that stand for their component: those with its smallest id. Rows whose id is
    null stay. Rows that share an id are one document and stay or go together; of those that agree in id and text one stays,
    the least by its other columns. Rows travel as one struct, so no name of a column matters."""
    linked = staged(joined(df, id_col, text_col), "keep-linked")
    gone = staged(linked.where("doc_id <> component_id").select("doc_id").distinct(), "keep-gone")
    twice = linked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    rows = df.select(field(id_col).alias("doc_id"), F.struct(*[field(c) for c in df.columns]).alias("row"))
    out = rows.join(small(gone, SMALL), "doc_id", "left_anti")
    if twice:
        known, text = out.where("doc_id IS NOT NULL"), F.sha2(F.coalesce(F.col("row").getField(text_col).cast("binary"), F.lit("").cast("binary")), 256)
        one = known.groupBy("doc_id", text.alias("digest")).agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = one.select("doc_id", "row").unionByName(out.where("doc_id IS NULL"))
    return out.select("row.*")
