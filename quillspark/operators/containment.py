"""Which texts contain which snippets: texts are read once by windows whose lengths are powers of two.

Of each snippet the driver sees two numbers alone: a hash of its first window, the longest such one that it holds, and a hash of its first
and last one, its length and its source. A text's windows are hashed by arrays, each length from the one of half; where a first window is
known, the whole is asked for. What is found goes on as bytes and is joined to the snippets, so no hash decides. A pass over the texts takes
a million snippets; pairs of other sources never become rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, staged

#: Bytes of snippets' numbers in one pass over the texts, and of each snippet.
BLOCK_BYTES, NUMBERS = 16 << 20, 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts that follow each other, and where each starts and the last ends; null is an empty one."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _windows(raw: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the window at each place) for the powers of two up to ``longest``."""
    size, h = 1, (raw.astype(np.uint64) + np.uint64(1)) * _ODD[0]
    while size <= longest and len(h):
        yield size, h
        h = (h[:-size] * (_ODD[1] + np.uint64(2 * size)) + h[size:]) * _ODD[2]
        size *= 2


def _whole(first: np.ndarray, last: np.ndarray, size: np.ndarray | int, source: np.ndarray) -> np.ndarray:
    return ((first * _ODD[3] + last) * _ODD[1] + np.asarray(size, np.uint64)) * _ODD[2] + source


def _codes(sources: pa.Array) -> np.ndarray:
    """A number for each source."""
    known: dict[str, int] = {}
    for s in sources.to_pylist():
        if s not in known:
            known[s] = int.from_bytes(hashlib.blake2b(str(s).encode("utf-8", "surrogatepass"), digest_size=8).digest())
    return np.array([known[s] for s in sources.to_pylist()], np.uint64)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, first, whole) of snippets, none of them empty."""
    for batch in sliced(batches, "snippet"):
        raw, at = _bytes(batch.column("snippet"))
        sizes, source = np.diff(at), _codes(batch.column("source"))
        first, whole = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        for q, h in _windows(raw, int(sizes.max(initial=0))):
            own = np.flatnonzero((sizes >= q) & (sizes < 2 * q))
            first[own] = h[at[own]]
            whole[own] = _whole(h[at[own]], h[at[own + 1] - q], sizes[own], source[own])
        yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(first.view(np.int64)), pa.array(whole.view(np.int64))], names=["size", "first", "whole"])


class _Set:
    """Numbers that are asked for by arrays: a table of their upper bits answers for most of the others."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.sorted = np.unique(numbers)
        self.shift = np.uint64(64 - max(10, int(16 * len(self.sorted)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.bool_)
        self.table[self.sorted >> self.shift] = True

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Where the numbers stand that are in the set."""
        at = np.flatnonzero(self.table[asked >> self.shift])
        near = np.minimum(np.searchsorted(self.sorted, asked[at]), len(self.sorted) - 1)
        return at[self.sorted[near] == asked[at]]


class Snippets:
    """What is asked of texts: for each length of windows the first ones, and the whole of each length of snippets."""

    def __init__(self, sizes: np.ndarray, first: np.ndarray, whole: np.ndarray) -> None:
        self.longest = int(sizes.max())
        self.asked: dict[int, tuple[_Set, list[tuple[int, _Set]]]] = {}
        q = 1
        while q <= self.longest:
            own = (sizes >= q) & (sizes < 2 * q)
            if own.any():
                self.asked[q] = _Set(first[own]), [(int(n), _Set(whole[sizes == n])) for n in np.unique(sizes[own])]
            q *= 2

    def found(self, texts: pa.Array, sources: pa.Array) -> set[tuple[int, bytes]]:
        """(number of the text, piece) of what may be a snippet of its source."""
        raw, at = _bytes(texts)
        codes, out = _codes(sources), set()
        for q, h in _windows(raw, self.longest):
            if q not in self.asked:
                continue
            first, sizes = self.asked[q]
            starts = first.places(h)
            text = np.searchsorted(at, starts, "right") - 1
            for n, whole in sizes:
                inside = starts + n <= at[text + 1]
                s, t = starts[inside], text[inside]
                hit = whole.places(_whole(h[s], h[s + n - q], n, codes[t]))
                out.update((i, raw[a : a + n].tobytes()) for i, a in zip(t[hit].tolist(), s[hit].tolist(), strict=True))
        return out


def containing(texts: DataFrame, snippets: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, id) of the snippets (key, source, snippet) and the texts (id, source, text) of the same source in which they stand,
    once each. An empty snippet stands in every text; nulls match nothing."""
    known = staged(snippets.where("key IS NOT NULL AND source IS NOT NULL AND snippet IS NOT NULL").select("key", F.col("source").cast("string").alias("source"), "snippet", F.sha2("snippet", 256).alias("digest")), "snippets")
    small_batches(texts.sparkSession)
    numbers = known.where("snippet <> ''").select("source", "snippet").distinct().mapInArrow(_numbers, "size long, first long, whole long")
    numbers = staged(numbers, "snippet-numbers")
    blocks = -(-numbers.count() * NUMBERS // block_bytes)
    kinds = dict(texts.dtypes)
    # no condition on the text: it would be worked out once more to be held against it
    rows = texts.select("id", F.col("source").cast("string").alias("source"), "text").where("source IS NOT NULL")
    if blocks > 1:
        rows = staged(rows, "snippet-texts")

    def through(wanted: Snippets):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                found = sorted(wanted.found(batch.column("text"), batch.column("source")))
                at = pa.array([i for i, _ in found], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("source").take(at), pa.array([p for _, p in found], pa.binary())], names=["id", "source", "piece"])

        return run

    keys = known.select("key", "source", "digest")
    out = keys.where(F.col("digest") == F.sha2(F.lit(""), 256)).select("key", "source")
    out = out.join(rows.where("text IS NOT NULL").select("id", "source"), "source").select("key", "id") if out.take(1) else None
    for b in range(blocks):
        # one pass is bounded by the choice of their number
        block = numbers.where(F.pmod(F.xxhash64("whole"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        size, first, whole = (block.column(c).to_numpy() for c in ("size", "first", "whole"))
        hits = rows.mapInArrow(through(Snippets(size, first.view(np.uint64), whole.view(np.uint64))), f"id {kinds['id']}, source string, piece binary")
        pairs = keys.join(hits.select("id", "source", F.sha2("piece", 256).alias("digest")), ["digest", "source"]).select("key", "id")
        out = pairs if out is None else out.unionByName(pairs)
    return known.join(rows.select("id"), F.lit(False)).select("key", "id") if out is None else out.distinct()
