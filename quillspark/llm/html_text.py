"""HTML extraction: the main text of a page, with boilerplate found by suffix arrays over the token streams of its host.

Markup gives blocks, each of one of three kinds. What stands in an article (or, without one, in a main element) is sure. Menus, headers
(in an article all but its headings), footers, asides, forms, dialogs, scripts, hidden parts and elements whose class, id or role
names such a thing, an advert, a notice or comments are out. In doubt are the blocks of pages without article and main, and elements
whose class is only often boilerplate (shares, related pages, tags): these the host decides.

The streams of a host's blocks in doubt are dealt into slices of bounded size, so that a host of any size spreads over tasks.
A slice concatenates its streams, sorts their suffixes by the first RUN tokens (ranks double from one token on) and gives a row for each
different start of a suffix with the number of pages that have it; added up over slices, starts on two pages or more are repeats.
Their union are all long substrings that repeat across distinct pages. Pages with the same stream count once, so copies
are no repeat of each other. In a block that repeats cover by half or more only runs of RUN or more uncovered tokens are kept; other
blocks stay whole; and a page of which less than UNIQUE would be left is a near copy of another and stays whole.

White space is what str.split takes for it. A null or empty page has the empty text; a null url is the host "". Unclosed elements
end where HTML ends them, unclosed comments, scripts and quoted attributes with the page. Repeated rows and ids are rows of their own.
Pages of any size are read whole, in time that grows with their length. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, sliced, small_batches, staged

RUN, UNIQUE = 8, 0.1
#: Characters of streams in a slice.
SLICE_CHARS = 4 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What a start tag ends if it is open, up to the element that bounds it.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd dt", ("dl",)), "dd": ("dd dt", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr", ("table",)), "option": ("option", ("select",))}
ENDS_P = BLOCK - {"body", "head", "html", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
RAW = frozenset("script style iframe noembed noframes textarea title xmp".split())
OUT_TAGS = frozenset("aside audio button canvas datalist dialog embed footer form head iframe menu nav noscript object script select style svg template textarea title video xmp".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
OUT_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices overlay pager pagination popup replies reply respond sidebar sidebars signup sponsor sponsored subscribe subscription toolbar".split()
)
DOUBT_WORDS = frozenset("byline copyright disclaimer legal license meta more popular promo recommended related share sharing social tags toc trending widget widgets".split())
NOT_OF = frozenset("has no not with without".split())
UNMARKED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())

LEXER = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

NEUTRAL, OUT, DOUBT, ARTICLE, MAIN, HEADER = range(6)


def named_kind(names: str, whole_names: bool = False) -> int:
    """OUT or DOUBT if a class or id among ``names`` begins or ends with such a word (``whole_names``: is one), else NEUTRAL."""
    found = NEUTRAL
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not words or NOT_OF.intersection(words) or (whole_names and len(words) > 1):
            continue
        if words[0] in OUT_WORDS or words[-1] in OUT_WORDS:
            return OUT
        if words[0] in DOUBT_WORDS or words[-1] in DOUBT_WORDS:
            found = DOUBT
    return found


def kind_of(name: str, attrs: str, in_article: bool) -> int:
    if name in OUT_TAGS:
        return OUT
    known = {}
    for m in ATTRIBUTE.finditer(attrs) if attrs.strip(" \t\n\f\r/") else ():
        known.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    if "hidden" in known or known.get("aria-hidden", "").lower() == "true" or UNSEEN.search(known.get("style", "")):
        return OUT
    role = known.get("role", "").lower()
    if role in OUT_ROLES:
        return OUT
    names = known.get("class", "") + " " + known.get("id", "")
    if name == "article" or role == "article" or known.get("itemprop") == "articleBody":
        return OUT if named_kind(names, whole_names=True) == OUT else ARTICLE
    if name == "main" or role == "main":
        return MAIN
    if name == "header" or (name not in UNMARKED and "header" in names.lower().split()):
        return HEADER if in_article else OUT
    if name in UNMARKED:
        return NEUTRAL
    found = named_kind(names)
    return found if found == OUT or name in BLOCK else NEUTRAL


class Page:
    """Reads a page into blocks of (in an article, in a main element, in doubt by name, text). Every step takes constant time on
    average: open elements are found by name, an inline element that ends outside its block leaves a gap."""

    def __init__(self) -> None:
        self.blocks: list[tuple[bool, bool, bool, str]] = []
        self.stack: list[tuple[str, int] | None] = []
        self.at: dict[str, list[int]] = {}
        self.block_at: list[int] = []
        self.inside = [0] * 6
        self.headings = 0
        self.parts: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append((self.inside[ARTICLE] > 0, self.inside[MAIN] > 0, self.inside[DOUBT] > 0, text))

    def text(self, raw: str) -> None:
        if not self.inside[OUT] and (not self.inside[HEADER] or self.headings):
            self.parts.append(html.unescape(raw) if "&" in raw else raw)

    def leave(self, i: int) -> None:
        name, kind = self.stack[i]
        self.inside[kind] -= 1
        self.headings -= name in HEADINGS
        self.at[name].pop()

    def pop_to(self, i: int) -> None:
        """Closes all from the top down to element ``i``."""
        if self.block_at and self.block_at[-1] >= i:
            self.flush()
        while len(self.stack) > i:
            if self.stack[-1] is not None:
                self.leave(len(self.stack) - 1)
            self.stack.pop()
        while self.block_at and self.block_at[-1] >= i:
            self.block_at.pop()

    def last(self, name: str) -> int:
        held = self.at.get(name)
        return held[-1] if held else -1

    def start(self, name: str, attrs: str) -> None:
        if name in VOID:
            if name in ("br", "hr"):
                self.flush() if name == "hr" else self.text(" ")
            return
        if name in ENDS_P and self.last("p") > max(self.last("button"), self.last("td"), self.last("th"), self.last("caption"), self.last("table"), self.last("object")):
            self.pop_to(self.last("p"))
        if name in ENDS:
            ended, bounds = ENDS[name]
            i = max(self.last(x) for x in ended.split())
            if i > max(self.last(x) for x in bounds):
                self.pop_to(i)
        if name in HEADINGS and self.block_at and self.stack[self.block_at[-1]][0] in HEADINGS:
            self.pop_to(self.block_at[-1])
        kind = kind_of(name, attrs, self.inside[ARTICLE] > 0)
        if name in BLOCK:
            self.flush()
            self.block_at.append(len(self.stack))
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, kind))
        self.inside[kind] += 1
        self.headings += name in HEADINGS

    def end(self, name: str) -> None:
        i = self.last(name)
        if name in HEADINGS and i < 0:
            i = max(self.last(h) for h in HEADINGS)
        if i < 0:
            if name == "p":
                self.flush()
            elif name == "br":
                self.text(" ")
            return
        if name not in BLOCK and self.block_at and self.block_at[-1] > i:
            self.leave(i)
            self.stack[i] = None
        else:
            self.pop_to(i)


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def page_blocks(source: str) -> list[tuple[bool, str]]:
    """(sure, text) of the blocks of a page that may belong to its main text, in page order."""
    page, done = Page(), 0
    while m := LEXER.search(source, done):
        if m.start() > done:
            page.text(source[done : m.start()])
        done = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            page.end(name)
            continue
        page.start(name, m["attrs"])
        if name in RAW:
            closed = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, done)
            done = closed.start() if closed else len(source)
    page.text(source[done:])
    page.flush()
    for within in (0, 1):
        found = [(not b[2], b[3]) for b in page.blocks if b[within]]
        if found:
            return found
    return [(False, b[3]) for b in page.blocks]


def starts(pages: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A suffix array of the concatenated token lists, sorted to a depth of ``run`` tokens (a power of two): for each place of the
    concatenation the rank of its suffix (-1 where fewer than ``run`` tokens of the page are left), the place's page, and where each page
    begins. Suffixes of one rank begin with the same ``run`` tokens."""
    numbers: dict[str, int] = {}
    tokens = np.fromiter((numbers.setdefault(t, len(numbers)) for p in pages for t in p), np.int64)
    lengths = np.array([len(p) for p in pages], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    page = np.repeat(np.arange(len(pages)), lengths)
    left = begins[page + 1] - np.arange(len(tokens)) if len(tokens) else tokens
    rank, depth = tokens, 1
    while depth < run:
        later = np.full(len(rank), -1, np.int64)
        later[:-depth] = rank[depth:]
        later[left <= depth] = -1
        rank = np.unique(rank * (len(rank) + len(numbers) + 2) + later + 1, return_inverse=True)[1].reshape(-1)
        depth *= 2
    return np.where(left >= run, rank, -1), page, begins.tolist()


def gram(tokens: list[str]) -> bytes:
    return hashlib.blake2b("\0".join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def slice_starts(streams: list[str], run: int = RUN) -> tuple[list[list[str]], np.ndarray, list[int], dict[int, bytes], dict[int, int]]:
    """Token lists, ranks and page begins of a slice, with the digest of each rank and the number of pages that have it."""
    pages = [s.split() for s in streams]
    rank, page, begins = starts(pages, run)
    places = np.flatnonzero(rank >= 0)
    ranks, first = np.unique(rank[places], return_index=True)
    names = {}
    for r, i in zip(ranks.tolist(), places[first].tolist(), strict=True):
        p = int(page[i])
        names[r] = gram(pages[p][i - begins[p] : i - begins[p] + run])
    pairs = np.unique(np.stack([rank[places], page[places]]), axis=1)[0] if len(places) else places
    on = dict(zip(*(x.tolist() for x in np.unique(pairs, return_counts=True)), strict=True))
    return pages, rank, begins, names, on


def kept_blocks(blocks: list[str], covered: np.ndarray, run: int = RUN, unique: float = UNIQUE) -> list[str | None]:
    """What is left of each block, from which of the page's tokens are covered by repeats."""
    if not len(covered) or (~covered).sum() < unique * len(covered):
        return list(blocks)
    out: list[str | None] = []
    at = 0
    for block in blocks:
        tokens = block.split()
        mine = covered[at : at + len(tokens)]
        at += len(tokens)
        if 2 * mine.sum() < len(tokens):
            out.append(block)
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], mine.astype(np.int8), [1]])))
        runs = [tokens[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= run]
        out.append(" ".join(t for r in runs for t in r) if runs else None)
    return out


def parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, host, text (null if blocks are in doubt), key and blocks (at: place among the blocks in doubt, -1 if sure)."""
    small_batches(pages.sparkSession)
    rows = pages.select(field(id_col).alias("page_id"), field(url_col).alias("url"), field(html_col).cast("binary").alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    schema = f"page_id {kind}, url string, host string, text string, key binary, blocks array<struct<at: int, text: string>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def read(url: str | None, data: bytes | None) -> dict:
        host = re.match(r"[^:]*?://([^/?#]*)", url or "")
        row = {"host": host[1].lower() if host else "", "text": None, "key": None, "blocks": None}
        found = page_blocks((data or b"").decode("utf-8", "replace"))
        doubt = [text for sure, text in found if not sure]
        if not doubt:
            return row | {"text": "\n\n".join(text for _, text in found)}
        numbers = iter(range(len(doubt)))
        return row | {"key": hashlib.sha256("\n".join(doubt).encode()).digest(), "blocks": [{"at": -1 if sure else next(numbers), "text": text} for sure, text in found]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            got = [read(u, h) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
            made = [pa.array([g[f.name] for g in got], f.type) for f in list(arrow)[2:]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(arrow.field("page_id").type), batch.column("url").cast(arrow.field("url").type), *made], schema=arrow)

    return rows.mapInArrow(run, schema)


def decided(doubtful: DataFrame, slice_chars: int = SLICE_CHARS, run: int = RUN) -> DataFrame:
    """(host, key, kept) from (host, key, blocks): what each different stream of a host keeps of its blocks in doubt."""
    stream = F.array_join(F.transform(F.filter("blocks", lambda b: b["at"] >= 0), lambda b: b["text"]), "\n")
    streams = doubtful.select("host", "key", stream.alias("stream")).groupBy("host", "key").agg(F.min("stream").alias("stream"))
    streams = staged(streams, "html-streams")
    sizes = staged(streams.groupBy("host").agg(F.sum(F.length("stream")).alias("chars")), "html-sizes")
    slices = F.pmod(F.xxhash64("key"), F.ceil(F.col("chars") / slice_chars).cast("long"))
    dealt = staged(streams.join(sizes, "host").withColumn("slice", slices).drop("chars"), "html-slices")

    def counted(key: tuple, rows):
        import pandas as pd

        *_, names, on = slice_starts(rows["stream"].tolist(), run)
        return pd.DataFrame({"host": key[0], "slice": key[1], "gram": list(names.values()), "pages": [on[r] for r in names]}, columns=["host", "slice", "gram", "pages"])

    grams = staged(dealt.groupBy("host", "slice").applyInPandas(counted, "host string, slice long, gram binary, pages long"), "html-grams")
    often = staged(grams.groupBy("host", "gram").agg(F.sum("pages").alias("pages")).where("pages > 1").drop("pages"), "html-repeats")
    repeats = grams.join(often, ["host", "gram"], "left_semi").select("host", "slice", "gram")

    def keep(key: tuple, rows, known):
        import pandas as pd

        pages, rank, begins, names, _ = slice_starts(rows["stream"].tolist(), run)
        wanted = set(map(bytes, known["gram"]))
        hit = np.isin(rank, [r for r, g in names.items() if g in wanted])
        reach = np.concatenate([hit.astype(np.int64), np.zeros(run, np.int64)])
        np.subtract.at(reach, np.flatnonzero(hit) + run, 1)
        covered = np.cumsum(reach)[: len(rank)] > 0
        kept = [kept_blocks(s.split("\n"), covered[a:b], run) for s, a, b in zip(rows["stream"], begins, begins[1:], strict=False)]
        return pd.DataFrame({"host": key[0], "key": rows["key"].tolist(), "kept": kept}, columns=["host", "key", "kept"])

    return dealt.groupBy("host", "slice").cogroup(repeats.groupBy("host", "slice")).applyInPandas(keep, "host string, key binary, kept array<string>")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """page_id, url, text and n_chars of each page. Pages are read once, into a table in the shared folder; only blocks in doubt
    are shuffled."""
    table = staged(parsed(pages, id_col, url_col, html_col), "html-pages")
    clear = table.where("key IS NULL").select("page_id", "url", "text")
    doubtful = table.where("key IS NOT NULL")
    kept = staged(decided(doubtful.select("host", "key", "blocks"), slice_chars), "html-kept")
    parts = F.expr("filter(transform(blocks, b -> CASE WHEN b.at < 0 THEN b.text ELSE kept[b.at] END), x -> x IS NOT NULL)")
    settled = doubtful.join(kept, ["host", "key"]).select("page_id", "url", F.array_join(parts, "\n\n").alias("text"))
    return clear.unionByName(settled).withColumn("n_chars", F.length("text").cast("long"))
