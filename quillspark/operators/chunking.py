"""Sentences, passages of bounded size, places that name a passage, and what is shown of it.

Sentences, list pieces and joins of what belongs together are expressions and windows. Packing up to a number of words reads a
document's units in order, each step resting on the one before; that runs as Arrow batches of whole documents.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import pattern
from ..functions.text import SPACES, UNUSUAL, trimmed, wide
from .common import sliced, small_batches

#: Words whose full stop ends no sentence. Fixed values.
ABBREVIATIONS = "u.s u.s.c no inc corp co etc vs dr mr mrs ms jr sr st dept fig".split()
#: Signs that stand before an item of a list. Fixed values.
MARKERS = "•■□♦○▪●∙»−❶-❿"
#: Words in a passage, in the opening that answers, and characters beside a passage that may tell it from others. Fixed values.
TARGET, ANSWER_WORDS, BESIDE = 256, 120, 64
#: A noncharacter: no text has it.
CUT = "\U0010ffff"
_SPACE = re.compile(f"[{SPACES}]")
_SENTENCE = (
    r"(?=[.!?])(?<![.!?])(?<!(?:^|[" + SPACES + r"])(?i:" + "|".join(map(re.escape, ABBREVIATIONS)) + r"))"
    r"[.!?]+[\"')\]]*[" + SPACES + r"]+(?=[A-Z0-9])"
)
_LIST = f"[{SPACES}]*[{MARKERS}]+[{SPACES}]*"


def sentences(text: Column) -> Column:
    """The text cut after each sentence and the white space behind it, so that the pieces are the text; an empty text is one
    empty piece."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _SENTENCE, f"$0{CUT}"), CUT)


def list_pieces(text: Column) -> Column:
    """The text cut before each sign of a list but one at its front."""
    return F.filter(F.split(F.regexp_replace(text, f"(?<!^)({_LIST})", f"{CUT}$1"), CUT), lambda x: x != "")


def words_in(text: str) -> int:
    return len(text.split())


# ---- passages --------------------------------------------------------------------------------------------------------

_ENDS = re.compile(r"[.!?]+[\"')\]]*[" + SPACES + r"]+(?=[A-Z0-9])")
_MARKS = re.compile(_LIST)
#: Characters that aren't of words; all are below U+3001.
_BLANKS = np.array([chr(c).isspace() for c in range(0x3001)])
_RESOLVES = re.compile(rf"[{SPACES}]*(?:TRUE|FALSE)[{SPACES}]*:", re.I)


class Words:
    """Where the words of a text start and end: how many a stretch holds takes two searches, however long it is."""

    def __init__(self, text: str) -> None:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.flatnonzero(np.diff(~_BLANKS[np.minimum(raw, 0x2FFF + (raw == 0x3000))], prepend=False, append=False)).tolist()
        self.starts, self.ends = edges[::2], edges[1::2]

    def first(self, start: int) -> int:
        """Number of the first word that ends after ``start``."""
        return bisect_right(self.ends, start)

    def held(self, start: int, end: int) -> int:
        return max(0, bisect_left(self.starts, end) - self.first(start))

    def windows(self, start: int, end: int, target: int) -> list[tuple[int, int]]:
        """The stretch cut behind each ``target``-th of its words, but the last."""
        first = self.first(start)
        cuts = [self.ends[k] for k in range(first + target - 1, first + self.held(start, end) - 1, target)]
        return list(zip([start, *cuts], [*cuts, end], strict=True))


def _left_open(text: str, start: int, end: int) -> bool:
    """Whether a stretch ends with a colon, or with a comma and the word and or or."""
    while end > start and _SPACE.match(text[end - 1]):
        end -= 1
    for word in ("and", "or"):
        at = end - len(word)
        if at >= start and text[at:end].lower() == word:
            while at > start and _SPACE.match(text[at - 1]):
                at -= 1
            return at > start and text[at - 1] == ","
    return end > start and text[end - 1] == ":"


def _cuts(text: str, start: int, end: int, ends: bool) -> list[tuple[int, int]]:
    """Sentences, or pieces of a list, of a stretch of text."""
    at = [start]
    for m in (_ENDS if ends else _MARKS).finditer(text, start, end):
        if ends:
            word = m.start()
            while word > start and not _SPACE.match(text[word - 1]):
                word -= 1
            if text[word : m.start()].lower() in ABBREVIATIONS or m.end() >= end:
                continue
            at.append(m.end())
        elif m.start() > start:
            at.append(m.start())
    return [(a, b) for a, b in zip(at, [*at[1:], end], strict=True) if a < b]


def _units(text: str, start: int, end: int, target: int, words: Words) -> list[tuple[int, int, bool]]:
    """(start, end, inside a sentence) of pieces that hold ``target`` at most: the stretch, its sentences, list pieces, or words."""
    if words.held(start, end) <= target:
        return [(start, end, False)]
    for ends in (True, False):
        parts = _cuts(text, start, end, ends)
        if len(parts) > 1:
            return [unit for a, b in parts for unit in _units(text, a, b, target, words)]
    return [(a, b, True) for a, b in words.windows(start, end, target)]


def passages_of(text: str, blocks: list[tuple[str, str | None, int | None]], target: int = TARGET) -> list[tuple[int, int, str | None, int | None, bool]]:
    """(start, end, section, page, cut inside a sentence) of passages that follow each other in ``text``, from its blocks (text,
    section, page). A unit that settles the one before, or follows one that leaves its clause open, stays with it; units of one
    section are put together as long as their joint stretch holds ``target`` words. Raises ValueError for a block that isn't there."""
    words, units, at = Words(text), [], 0
    for block, section, page in blocks:
        found = text.find(block, at)
        if found < 0:
            raise ValueError("a block isn't in the text")
        at = found + len(block)
        for a, b, broken in _units(text, found, at, target, words):
            last = units[-1] if units else None
            if last and last[2] == section and (_RESOLVES.match(text, a, b) or _left_open(text, last[0], last[1])):
                units[-1] = (last[0], b, section, last[3], last[4] or broken)
            else:
                units.append((a, b, section, page, broken))
    out = []
    for a, b, section, page, broken in units:
        if out and out[-1][2] == section and words.held(out[-1][0], b) <= target:
            out[-1] = (out[-1][0], b, section, out[-1][3], out[-1][4] or broken)
        else:
            out.append((a, b, section, page, broken))
    trimmed_ = []
    for a, b, *rest in out:
        while a < b and _SPACE.match(text[a]):
            a += 1
        while a < b and _SPACE.match(text[b - 1]):
            b -= 1
        trimmed_.append((a, b, *rest))
    return trimmed_


def passages(docs: DataFrame, target: int = TARGET, texts: bool = False) -> DataFrame:
    """(id, nth, start, end, section, page, broken), and passage if ``texts``, from (id, text, blocks: array of text, section, page). A
    document whose blocks aren't in its text in order has one row with nth -1 and null places."""
    schema = f"id {dict(docs.dtypes)['id']}, nth int, start int, end int, section string, page int, broken boolean" + (", passage string" if texts else "")
    names = ["id", "nth", "start", "end", "section", "page", "broken", "passage"][: 7 + texts]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows, at = [], 0
            flat = batch.column("blocks").flatten()
            blocks = list(zip(*(flat.field(c).to_pylist() for c in ("text", "section", "page")), strict=True))
            for i, text, n in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), pa.compute.list_value_length(batch.column("blocks")).to_pylist(), strict=True):
                own, at = blocks[at : at + (n or 0)], at + (n or 0)
                try:
                    found = passages_of(text or "", own, target)
                except ValueError:
                    rows.append((i, -1, None, None, None, None, None, None)[: len(names)])
                    continue
                rows += [(i, k, a, b, section, page, broken, *([text[a:b]] if texts else ())) for k, (a, b, section, page, broken) in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = (batch.column("id").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string())[: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select("id", "text", "blocks").mapInArrow(run, schema)


# ---- places that name a passage --------------------------------------------------------------------------------------


def occurrences(text: str, part: str, most: int | None = None) -> int:
    """How often ``part`` stands in the text, overlaps counted, up to ``most``; none for an empty part."""
    n, at = 0, text.find(part) if part else -1
    while at >= 0 and (most is None or n < most):
        n += 1
        at = text.find(part, at + 1)
    return n


def _tidy(text: str) -> str:
    """Canonical form of a piece of canonical text: white space is all that can change."""
    return re.sub(f"[{SPACES}]+", " ", text).strip(" ")


def anchor_of(text: str, start: int, end: int, bound: int = BESIDE) -> tuple[str, str, str] | None:
    """(before, exact, after): the passage and the fewest characters beside it, as many on either side, by which it stands in the
    text once; None if ``bound`` aren't enough. The text is searched for the passage alone; only where it stands are the characters
    beside it compared."""
    exact, wanted = text[start:end], _tidy(text[start:end])
    core = end - len(exact.lstrip(" "))
    places, at = [], text.find(wanted)
    while wanted and at >= 0:
        places.append(at)
        at = text.find(wanted, at + 1)
    for n in range(bound + 1):
        low, high = max(0, start - n), min(len(text), end + n)
        wide = _tidy(text[low:high])
        if wanted:
            back = core - high + len(text[low:high].lstrip(" "))
            places = [p for p in places if p >= back and text.startswith(wide, p - back)]
        if (len(places) if wanted else occurrences(text, wide, 2)) == 1:
            return text[low:start], exact, text[end:high]
        if low == 0 and high == len(text):
            break
    return None


def anchors(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, start, end, found, prefix, suffix) for the spans (id, start, end) of the texts (id, text)."""
    listed = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = dict(docs.dtypes)["id"]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows = []
            for i, text, places in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans")), strict=True):
                for p in places:
                    got = anchor_of(text or "", p["start"], p["end"])
                    rows.append((i, p["start"], p["end"], got is not None, got and got[0], got and got[2]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (batch.column("id").type, pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "start", "end", "found", "prefix", "suffix"])

    return docs.join(listed, "id").select("id", "text", "spans").mapInArrow(run, f"id {kind}, start int, end int, found boolean, prefix string, suffix string")


# ---- finding a passage again. Fixed values ---------------------------------------------------------------------------

COVERAGE, LARGEST_GAP, SMALLEST = 0.6, 400, 12
AROUND = ((0, 0), (0, 1), (1, 2))


def folded(text: str) -> tuple[str, list[int]]:
    """The text's letters a-z and digits, compatibility forms taken apart, in lower case, and where each stood. A letter folds as its
    capitals do (\u00df as ss), so that a passage is found whatever its case."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in c.lower() if c < "\x80" else unicodedata.normalize("NFKD", c.upper()).casefold():
            if "a" <= x <= "z" or "0" <= x <= "9":
                out.append(x)
                at.append(i)
    return "".join(out), at


class Repeats:
    """A suffix automaton: every substring of a text is a way through it. Reads another text once and gives the matches that can't be
    made longer."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [0]
        last = 0
        for i, c in enumerate(text):
            new = self._state({}, self.size[last] + 1, i + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.size[q] == self.size[p] + 1:
                    self.link[new] = q
                else:
                    short = self._state(dict(self.next[q]), self.size[p] + 1, self.end[q])
                    self.link[short], self.link[q], self.link[new] = self.link[q], short, short
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = short
                        p = self.link[p]
            else:
                self.link[new] = 0
            last = new

    def _state(self, ways: dict[str, int], size: int, end: int) -> int:
        self.next.append(ways)
        self.link.append(0)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def matches(self, other: str, least: int) -> list[tuple[int, int, int]]:
        """(start in the other text, start in this one, length) of the matches of ``least`` letters or more that no next letter goes
        on; in this text at their first place."""
        out, state, n = [], 0, 0
        for i, c in enumerate(other):
            if c not in self.next[state] and n >= least:
                out.append((i - n, self.end[state] - n, n))
            while state > 0 and c not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
        if n >= least:
            out.append((len(other) - n, self.end[state] - n, n))
        return out


class Letters:
    """folded() by arrays: the letters as bytes and where each stood, for one text or for many that follow each other."""

    _ascii = np.full(256, 255, np.uint8)
    for _c in range(128):
        if chr(_c).isalnum():
            _ascii[_c] = ord(chr(_c).lower())
    _other: dict[int, bytes] = {}

    def __init__(self, letters: np.ndarray, at: np.ndarray) -> None:
        self.letters, self.at, self.bytes = letters, at, letters.tobytes()

    @classmethod
    def of(cls, text: str) -> Letters:
        return cls(*cls._folded(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))[:2])

    @classmethod
    def _folded(cls, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a text in UTF-8: its letters, the character that each stood in, and the character that each byte is of."""
        got = cls._ascii[raw]
        wide = np.flatnonzero(raw >= 0xC0)
        if not len(wide):
            own = np.flatnonzero(got != 255)
            return got[own], own, np.arange(len(raw))
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        lead, tail = raw[wide].astype(np.int64), np.append(raw, np.zeros(3, np.uint8)).astype(np.int64) & 0x3F
        code = np.where(lead < 0xE0, (lead & 0x1F) << 6 | tail[wide + 1], (lead & 0x0F) << 12 | tail[wide + 1] << 6 | tail[wide + 2])
        code = np.where(lead < 0xF0, code, (lead & 0x07) << 18 | tail[wide + 1] << 12 | tail[wide + 2] << 6 | tail[wide + 3])
        codes, which = np.unique(code, return_inverse=True)
        parts = [cls._apart(c) for c in codes.tolist()]
        sizes = np.array([len(p) for p in parts])
        held = (got != 255).astype(np.int64)
        held[wide] = sizes[which]
        starts = np.cumsum(held) - held
        out = np.empty(int(starts[-1] + held[-1]), np.uint8)
        own = got != 255
        out[starts[own]] = got[own]
        for k in range(int(sizes.max())):
            more = wide[sizes[which] > k]
            out[starts[more] + k] = np.array([p[k] if len(p) > k else 0 for p in parts], np.uint8)[which[sizes[which] > k]]
        return out, np.repeat(character, held), character

    @classmethod
    def _apart(cls, c: int) -> bytes:
        if c not in cls._other:
            cls._other[c] = folded(chr(c))[0].encode()
        return cls._other[c]

    def runs(self, n: int) -> np.ndarray:
        """Each run of ``n`` letters (12 at most) as a number of its own."""
        digit = np.where(self.letters < 97, self.letters - 48, self.letters - 87).astype(np.int64)
        out = np.zeros(max(0, len(digit) - n + 1), np.int64)
        for k in range(n):
            out = out * 36 + digit[k : k + len(out)]
        return out


class Texts:
    """The letters of many texts, folded at once: ``bounds`` are where each text's letters start, ``first`` its first character."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        letters, at, character = Letters._folded(raw)
        self.all = Letters(letters, at)
        self.first = np.append(character, character[-1] + 1 if len(raw) else 0)[offsets - offsets[0]]
        self.bounds = np.searchsorted(at, self.first)
        self.sizes = np.diff(self.first)
        self.runs = self.all.runs(SMALLEST)

    def letters(self, first: int, last: int) -> bytes:
        """Of the texts from ``first`` on, before ``last``."""
        return self.all.bytes[self.bounds[first] : self.bounds[last]]

    def runs_of(self, first: int, last: int) -> np.ndarray:
        return self.runs[self.bounds[first] : max(self.bounds[first], self.bounds[last] - SMALLEST + 1)]


def matches(needle: Letters, known: np.ndarray, hay: Letters, least: int) -> list[tuple[int, int, int]]:
    """What Repeats(needle).matches(hay, least) gives. ``known`` are the needle's runs of ``least`` letters, sorted."""
    return _matched(needle.bytes, known, hay.bytes, hay.runs(least), least)


def _matched(text: bytes, known: np.ndarray, other: bytes, runs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Only where the other text has one of the ``known`` runs a match is looked for, and its ends are found by halving."""
    if not len(runs) or not len(known):
        return []
    near = np.searchsorted(known, runs)
    near[near == len(known)] = 0
    starts, out = np.flatnonzero(known[near] == runs).tolist(), []
    at = 0
    while at < len(starts):
        start, end = starts[at], starts[at] + least
        while True:
            # the longest that starts here
            step = 1
            while end + step <= len(other) and other[start : end + step] in text:
                end += step
                step *= 2
            while step > 1:
                step //= 2
                if end + step <= len(other) and other[start : end + step] in text:
                    end += step
            out.append((start, text.find(other[start:end]), end - start))
            # the first start behind it from which the next letter goes on
            last = end + 1 - least
            if end == len(other) or other[last : end + 1] not in text:
                break
            low, high = start + 1, last
            while low < high:
                mid = (low + high) // 2
                if other[mid : end + 1] in text:
                    high = mid
                else:
                    low = mid + 1
            start, end = low, end + 1
        at = bisect_left(starts, end + 2 - least, at + 1)
    return out


def _chained(needle: bytes, known: np.ndarray | None, hay: bytes, runs: np.ndarray) -> tuple[int, int, float] | None:
    """(start, end, coverage) in the hay's letters of the best chain of matches. ``runs`` are those of SMALLEST letters of the hay, and
    ``known`` the needle's, sorted; a needle of fewer stands whole or not at all."""
    size, least = len(needle), min(SMALLEST, len(needle))
    if not size or len(hay) < COVERAGE * size:  # a chain covers no more than it takes of the hay
        return None
    whole = hay.find(needle)
    if whole >= 0 and hay.find(needle[:least]) == whole:  # no chain that starts before covers as much
        return whole, whole + size, 1.0
    if size < SMALLEST:
        return None
    chains: list[tuple[int, int, int]] = []  # covered, start of the chain, end in the text
    best = (0, 0, 0)
    found = _matched(needle, known, hay, runs, least)
    for k, (at, part, n) in enumerate(found):
        own = (n, at, at + n)
        for j in range(k - 1, -1, -1):
            before, there, m = found[j]
            if before + m + LARGEST_GAP < at:  # matches come by where they end
                break
            # nothing of the passage may be missing between two matches; where they overlap, by letters that a break and the
            # passage share, they count once
            if there < part <= there + m < part + n:
                covered = chains[j][0] + n - max(there + m - part, before + m - at)
                if covered > own[0]:
                    own = (covered, chains[j][1], at + n)
        chains.append(own)
        if own[0] > best[0]:
            best = own
    coverage = best[0] / size
    return (best[1], best[2], coverage) if coverage >= COVERAGE else None


def _read(passage: str) -> tuple[Letters, np.ndarray]:
    needle = Letters.of(passage)
    return needle, np.unique(needle.runs(min(SMALLEST, len(needle.bytes))))


def located(text: str, passage: str) -> tuple[int, int, float] | None:
    """(start, end, coverage) of where a passage stands in a text that may break it by up to LARGEST_GAP letters at a time: of the
    chains of matches that follow each other in both, the one that covers most of the passage, the first of such; None if that is
    too little."""
    (needle, known), hay = _read(passage), Letters.of(text)
    found = _chained(needle.bytes, known, hay.bytes, hay.runs(SMALLEST))
    return found and (int(hay.at[found[0]]), int(hay.at[found[1] - 1]) + 1, found[2])


def pages_around(cited: Column, n_pages: Column) -> Column:
    """The pages that are searched for a passage cited on one: it, one before and two after, within the document."""
    before, after = max(a for a, _ in AROUND), max(b for _, b in AROUND)
    return F.when((cited >= 1) & (cited <= n_pages), F.sequence(F.greatest(F.lit(1), cited - before), F.least(n_pages, cited + after))).otherwise(F.array().cast("array<int>"))


def _cited(pages: Texts, base: int, first: int, n_pages: int, cited: int | None, passages: Texts, k: int) -> list[tuple[int, int, int, float]]:
    """located_in_pages() of the passage ``k``; the document's pages from ``first`` on are the texts from ``base`` on."""
    if cited is None or not 1 <= cited <= n_pages:
        return []
    needle, known = passages.letters(k, k + 1), None
    for before, after in AROUND:
        low, high = base + max(1, cited - before) - first, base + min(n_pages, cited + after) - first + 1
        if known is None and len(needle) >= SMALLEST:
            known = np.sort(passages.runs_of(k, k + 1))
        found = _chained(needle, known, pages.letters(low, high), pages.runs_of(low, high))
        if found:
            start, end = pages.bounds[low] + found[0], pages.bounds[low] + found[1] - 1
            at, to = int(pages.all.at[start]), int(pages.all.at[end]) + 1
            bounds = [(n - base + first, int(pages.first[n]), int(pages.first[n + 1])) for n in range(low, high)]
            return [(n, max(at, a) - a, min(to, b) - a, found[2]) for n, a, b in bounds if max(at, a) < min(to, b)]
    return []


def located_in_pages(pages: list[str], cited: int | None, passage: str, first: int = 1, n_pages: int | None = None) -> list[tuple[int, int, int, float]]:
    """(page, start, end, coverage) of the parts of a passage that is cited on a page: that page alone, then with the next, then
    with one before and two after; nothing if it isn't there. Of a document's ``n_pages`` those from ``first`` on may be given alone."""
    return _cited(Texts(pa.array(pages, pa.string())), 0, first, len(pages) if n_pages is None else n_pages, cited, Texts(pa.array([passage], pa.string())), 0)


#: Cited pages of a document that are searched by one row, and how many citations, which then share its pages.
STRETCH, SHARED = 16, 256


def highlights(cited: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, page, start, end, coverage) for the citations (key, id, page, passage) of documents (id, pages: array of texts), a row for
    each page that has a part of the passage; a citation that isn't found, or whose document or page isn't there, has one row without
    page. Citations of a stretch of a document's pages share them, those that stand together and SHARED at most, and take along the
    pages that are searched for them, not the whole document."""
    before, after = max(a for a, _ in AROUND), max(b for _, b in AROUND)
    each = cited.select("id", F.struct("key", F.col("page").cast("int").alias("page"), "passage").alias("c"), F.floor(F.monotonically_increasing_id() / SHARED).alias("some"))
    shared = each.groupBy("id", F.floor((F.col("c.page") - 1) / STRETCH).alias("stretch"), "some").agg(F.collect_list("c").alias("cited"))
    first, last = (f(F.transform("cited", lambda c: c["page"])) for f in (F.array_min, F.array_max))
    rows = shared.join(docs.select("id", "pages"), "id", "left").select("cited", "pages", F.greatest(F.lit(1), first - before).alias("first"), (last + after).alias("last"), F.greatest(F.size("pages"), F.lit(0)).alias("n"))
    rows = rows.select("cited", F.when(F.col("last").isNotNull() & (F.col("first") <= F.col("n")), F.slice("pages", F.col("first"), F.greatest(F.least("last", "n") - F.col("first") + 1, F.lit(0)))).alias("pages"), "first", "n")
    small_batches(cited.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, lambda b: [x + y for x, y in zip(_held(b.column("pages"), b.column("pages").flatten()), _held(b.column("cited"), b.column("cited").flatten().field("passage")), strict=True)]):
            flat = batch.column("cited").flatten()
            pages, passages, asked = Texts(batch.column("pages").flatten()), Texts(flat.field("passage")), flat.field("page").to_pylist()
            base, k, at, out = 0, 0, [], []
            sizes = (pa.compute.list_value_length(batch.column(c)).fill_null(0).to_pylist() for c in ("pages", "cited"))
            for held, many, first, n in zip(*sizes, batch.column("first").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for k in range(k, k + many):
                    found = _cited(pages, base, first, n, asked[k], passages, k) if held else []
                    out += found or [(None,) * 4]
                    at += [k] * max(1, len(found))
                base, k = base + held, k + 1
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
            made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("key").take(pa.array(at, pa.int32())), *made], names=["key", "page", "start", "end", "coverage"])

    return rows.mapInArrow(run, f"key {dict(cited.dtypes)['key']}, page int, start int, end int, coverage double")


def _held(lists: pa.Array, texts: pa.Array) -> list[int]:
    """Bytes of the texts in each list, all of which are given beside them."""
    ends = np.append(0, np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)))
    return np.diff(ends[np.append(0, np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))]).tolist()


# ---- what is shown of a passage --------------------------------------------------------------------------------------

_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_DATE = rf"(?: +(?:Released|Revised))? +{_MONTH} \d{{4}}"
_VERSION = rf"(?:[A-Z]-\d{{1,3}}|[ivxlcdm]{{2,7}}|\d{{1,3}})?Version \d+(?:[. ]\d+)*{_DATE}(?:,?{_DATE})*(?: +for release .{{0,12}}?\d{{4}})?"
_TITLES = ("Finding a Place to Live and Community Resources", "Applying for Disability Compensation", "Introduction to Benefits and Services", "Maintaining Your Health", "Getting Career Ready", "Course Capstone")
#: What goes from a passage when it is shown, in order, and what stands in its place. A pattern that looks back looks first at the
#: letter it is for; before a pattern that may start with white space stands what none of its matches starts with. Fixed values.
SHOWN = (
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{e000}-\x{f8ff}\x{fffd}\x{110bb}]", ""),
    (rf"(?:{_VERSION}| *,\s*(?:Released|Revised) +{_MONTH} \d{{4}})", " "),
    (r"(?![!-DF-{}~])\s*(?:EFCT PARTICIPANT GUIDE|EMPLOYMENT WORKSHOP)?\s*\|\s*SECTION\s+\d+\s*\|(?:\s*PAGE\b)?(?:\s*\d+)?", " "),
    (rf"(?![!-LN-~])\s*Module \d+:\s*(?:{'|'.join(_TITLES)})", " "),
    (r"Links\s*page\s*\d+\s*(?=[A-Z])", " "),
    (r"(?![!-oq-~])(?:(?:^|\s)page ?\d+(?=[A-Z])|^\s*page\s+\d+\s+)", " "),
    (r"_{3,}", " "),
    (rf"{UNUSUAL}\s*(?:[{MARKERS}]\s*)+", " - "),
    (r"(?=[yo])(?:(?<=[^\s]{2}\s)|(?<=^)|(?<=^\s))\b[yo]\b(?=\s+[A-Za-z0-9]{2})", " - "),
)


def shown_text(text: Column) -> Column:
    """A passage as it is shown: what extraction left of fonts, headers, footers, page numbers and blanks goes, signs of lists
    become dashes, white space is one space. Never for ids or places."""
    for p, instead in SHOWN:
        text = F.regexp_replace(text, pattern(p), instead)
    text = trimmed(F.regexp_replace(text, wide(SPACES), " "))
    return trimmed(F.regexp_replace(text, "^(?:- )+|(?: -)+$", ""))


def opening(text: str, limit: int = ANSWER_WORDS) -> str:
    """The first whole sentences of a text that hold ``limit`` words together; a longer sentence that lists is cut at its dashes,
    and a first piece that is still longer at a word, with dots."""
    pieces: list[tuple[str, bool]] = []  # text, whether a dash stands before it
    for a, b in _cuts(text, 0, len(text), True):
        sentence = text[a:b].strip()
        if not sentence:
            continue
        if words_in(sentence) <= limit or " - " not in sentence:
            pieces.append((sentence, False))
            continue
        held, first = "", True
        for part in sentence.split(" - "):
            more = f"{held} - {part}" if held else part
            if held and words_in(more) > limit:
                pieces.append((held, not first))
                held, first = part, False
            else:
                held = more
        if held:
            pieces.append((held, not first))
    out, n = "", 0
    for piece, dash in pieces:
        size = words_in(piece)
        if not out and size > limit:
            return re.sub(r"(?: -)+$", "", " ".join(piece.split()[:limit])) + "..."
        if n + size > limit and out:
            break
        out, n = (f"{out}{' - ' if dash else ' '}{piece}" if out else piece), n + size
        if n >= ANSWER_WORDS:
            break
    return out


def openings(text: Column) -> Column:
    """opening() of each text; null of null."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else opening(x)), "string")(text)
