"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The frequent pre-tokens of the corpus (counted over all texts, with partial counts before the shuffle) are encoded once by
exact merges and compiled into a minimal acyclic automaton with shared suffixes. Each edge carries how many words lie before
it, so that a walk adds up to a word's number, which points to its ids. The arrays travel as one broadcast of bounded size
(LEXICON_WORDS words of at most WORD_BYTES bytes) and are memory-mapped by the workers. A pre-token that isn't in the
lexicon is merged exactly, so the lexicon changes speed and never results.

Null and empty texts: no ids, empty decoded text. Special tokens of the file that stand in a text become their ids, as
with the tokenizers library's defaults. Repeated rows are encoded each for itself. Very long texts are encoded whole; other columns
are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import sys
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, id_and_bytes, map_texts, staged

LEXICON_WORDS = 1 << 16
WORD_BYTES = 64
#: Entries of a worker's table of words met; a full one becomes the elder, of which only what is met again stays.
MEMO = 1 << 16
#: Pre-tokens of so many bytes keep the ranks of their pairs in a list, longer ones in a heap.
SHORT = 32


def _class(kinds: tuple[str, ...], top: int = sys.maxunicode) -> str:
    """A character class of all code points up to ``top`` whose general category starts with one of ``kinds``."""
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c)).startswith(kinds)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: White space of the Unicode standard, that of Latin-1 first. Fixed values.
SPACE = "\\t-\\r \\x85\\xa0", "\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _pattern(letter: str, number: str, space: str) -> re.Pattern:
    """Letters, contractions, digits or other characters, but for contractions each with at most one space before; white
    space, of which the last leaves a character to what follows."""
    return re.compile(f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def splitter() -> Callable[[str], list[str]]:
    """What cuts a text into pre-tokens. Texts of Latin-1 alone go by a pattern of small tables, which is faster."""
    latin = _pattern(_class(("L",), 255), _class(("N",), 255), SPACE[0]).findall
    every = _pattern(_class(("L",)), _class(("N",)), "".join(SPACE)).findall

    def split(text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return every(text)
        return latin(text)

    return split


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next
    of those from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(as_byte[c] for c in s)
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.bytes_of = {i: b for b, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.rank[ids[a], ids[b]] = (r, ids[a + b])
        self.order = {p: r for p, (r, _) in self.rank.items()}
        self.made = [ids[raw(a) + raw(b)] for a, b in pairs]

    def encode(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the pair of least rank is merged first, the leftmost of equals. A heap and linked neighbours
        keep long pre-tokens at n log n steps."""
        ids, rank = [self.byte_id[b] for b in word], self.rank
        n = len(ids)
        if n <= SHORT:
            get, made, none = self.order.get, self.made, len(self.made)
            ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (least := min(ranks)) < none:
                i = ranks.index(least)
                ids[i : i + 2] = [made[least]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), none)
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heap = [(r, i, p, new) for r, new, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] != pair[0] or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (got := rank.get(p := (ids[a], ids[b]))):
                    heapq.heappush(heap, (got[0], a, p, got[1]))
        return [x for x in ids if x >= 0]


# ---- the automaton ---------------------------------------------------------------------------------------------------


def compile_lexicon(words: Iterable[bytes], encode) -> bytes:
    """The minimal acyclic automaton of ``words`` with their ids, as flat arrays behind a header of lengths.

    Words come in sorted order, so the states off the last word's path can't change any more: each is looked up by its
    edges and finality and shared if it is there already."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # nodes of the last word: final, settled edges
    last, sorted_words = b"", sorted(set(words))

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))

    for word in sorted_words:
        shared = len(os.path.commonprefix([last, word]))
        close(shared)
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    close(0)
    root = settle(path[0])
    below: list[int] = []  # words reachable from a state; edges lead to earlier states
    for final, edges in states:
        below.append(final + sum(below[t] for _, t in edges))
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):
        skip = int(final)
        for label, t in edges:
            keys.append(s << 8 | label)
            targets.append(t)
            skips.append(skip)
            skip += below[t]
    ids = [encode(w) for w in sorted_words]
    offsets = np.cumsum([0, *map(len, ids)])
    parts = [np.array(keys, "<u4"), np.array(targets, "<u4"), np.array(skips, "<u4"), offsets.astype("<u4"), np.array([x for w in ids for x in w], "<u4"), np.array([final for final, _ in states], "<u4")]
    head = np.array([root, *(p.nbytes for p in parts)], "<u8")
    return head.tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon in a file, memory-mapped."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, "<u8", 7)
        self.root, at, parts = int(head[0]), head.nbytes, []
        for size in map(int, head[1:]):
            parts.append(np.frombuffer(self.map, "<u4", size // 4, at))
            at += size
        self.keys, self.targets, self.skips, self.offsets, self.ids, self.finals = parts

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """For each of ``words`` its ids as little-endian 32-bit integers, or None if the lexicon doesn't have it. All walk
        at once, a letter a step; edges are found by state and letter in their sorted order."""
        out: list[bytes | None] = [None] * len(words)
        if not words or not len(self.keys):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        on = np.flatnonzero(size)
        for step in range(int(size.max())):
            on = on[size[on] > step]
            if not len(on):
                break
            key = (state[on] << 8 | text[start[on] + step]).astype(np.uint32)
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            state[on[~hit]] = -1
            on, at = on[hit], at[hit]
            number[on] += self.skips[at]
            state[on] = self.targets[at]
        found = np.flatnonzero((state >= 0) & (size > 0))
        found = found[self.finals[state[found]] > 0]
        for k, lo, hi in zip(found.tolist(), self.offsets[number[found]].tolist(), self.offsets[number[found] + 1].tolist(), strict=True):
            out[k] = self.ids[lo:hi].tobytes()
        return out


def opened(blob: bytes) -> Lexicon:
    """The lexicon ``blob`` mapped from a file in the machine's temporary folder. The file has no name any more once it is
    mapped, so nothing stays behind a worker."""
    with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:
        f.write(blob)
        f.flush()
        return Lexicon(f.name)


# ---- over tables -----------------------------------------------------------------------------------------------------


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word as binary, n): how often each pre-token of at most WORD_BYTES bytes stands in all texts. Tasks count what they
    read before anything is shuffled."""

    def make():
        split = splitter()

        def work(_: list, texts: list[bytes]) -> dict:
            counts: Counter = Counter()
            for text in texts:
                counts.update(split(text.decode("utf-8", "replace")))
            words = [(w.encode("utf-8"), n) for w, n in counts.items() if len(w) <= WORD_BYTES]
            words = [(w, n) for w, n in words if 1 < len(w) <= WORD_BYTES]
            return {"word": [w for w, _ in words], "n": [n for _, n in words]}

        return work

    return map_texts(id_and_bytes(df, id_col, text_col), "word binary, n long", make).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, path: str, words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The compiled lexicon of the most frequent pre-tokens of ``df``, ``words`` at most. A histogram of counts in steps of
    about a hundredth gives the least count by which they are few enough; only words from it on come to the driver."""
    counts = staged(word_counts(df, id_col, text_col).where("n > 1").withColumn("step", F.floor(F.log2("n") * 64).cast("int")), "lexicon-counts")
    room, least = words, None
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    top = [] if least is None else counts.where(F.col("step") >= least).select("word").collect()
    dropped(counts)
    merges = Merges(path)
    return compile_lexicon((bytes(r["word"]) for r in top), merges.encode)


class Codec:
    """Encodes and decodes texts in one task."""

    def __init__(self, path: str, blob: bytes) -> None:
        self.merges, self.lexicon, self.split = Merges(path), opened(blob), splitter()
        self.memo: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.pieces = [self.merges.bytes_of.get(i, b"") for i in range(max(self.merges.bytes_of) + 1)]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The table of words met, with all of ``words`` in it: from the elder table, the lexicon or by merging."""
        if len(self.memo) >= MEMO:
            self.memo, self.elder = {}, self.memo
        memo, elder, new = self.memo, self.elder, []
        for w in words:
            if w not in memo:
                if w in elder:
                    memo[w] = elder[w]
                else:
                    new.append(w)
        raw = [w.encode("utf-8") for w in new]
        encode = self.merges.encode
        for w, b, ids in zip(new, raw, self.lexicon.find([b if len(b) <= WORD_BYTES else b"" for b in raw]), strict=True):
            memo[w] = ids if ids is not None else array("I", encode(b)).tobytes()
        return memo

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split, special = self.split, self.merges.special
        cut = []
        for text in texts:
            parts = self.special.split(text) if special and any(x in text for x in special) else (text,)
            cut.append([split(part) if k % 2 == 0 else part for k, part in enumerate(parts)])
        memo = self.learn({w for parts in cut for part in parts[::2] for w in part})
        own = {x: array("I", [i]).tobytes() for x, i in special.items()}
        return [b"".join(own[part] if k % 2 else b"".join(map(memo.__getitem__, part)) for k, part in enumerate(parts)) for parts in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, blob: bytes) -> Codec:
    """The worker's codec for a tokenizer and lexicon: its tables serve the tasks that follow. Others are let go."""
    key = (path, hashlib.sha256(blob).hexdigest())
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(path, blob)
    return _codecs[key]


COLUMNS = {"ids": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_texts(df: DataFrame, path: str, lexicon: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """doc_id and the asked ``columns``: ``ids`` (32-bit little-endian), their number and digest, the text that they decode
    to and its digest. ``path`` is a byte-level tokenizer file that every machine has; ``lexicon`` one from build_lexicon,
    by default that of ``df``."""
    blob = df.sparkSession.sparkContext.broadcast(build_lexicon(df, path, id_col=id_col, text_col=text_col) if lexicon is None else lexicon)

    def make():
        codec = codec_of(path, blob.value)

        def work(ids: list, texts: list[bytes]) -> dict:
            out: dict = {"doc_id": ids} | {c: [] for c in columns}
            for coded in codec.encode([x.decode("utf-8", "replace") for x in texts]):
                decoded = codec.decode(coded)
                row = {"ids": coded, "n_tokens": len(coded) // 4, "decoded": decoded}
                if "ids_sha256" in out:
                    row["ids_sha256"] = hashlib.sha256(coded).hexdigest()
                if "decoded_sha256" in out:
                    row["decoded_sha256"] = hashlib.sha256(decoded.encode("utf-8")).hexdigest()
                for c in columns:
                    out[c].append(row[c])
            return out

        return work

    return map_texts(id_and_bytes(df, id_col, text_col), "doc_id long, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns), make)
