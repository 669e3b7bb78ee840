"""Text of web pages: parsing, what is dropped, the content region, outermost blocks with their sections.

Parsing needs state from tag to tag, so it runs as Arrow batches of whole pages, a page at a time; what follows from the blocks
(sections, whole texts, checks) are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical
from ..functions.urls import DEFAULT_PORTS, off_origin_urls

#: Elements that hold content, what never counts, what leaves a content region, and what is set off by a space. Fixed values.
BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote dt dd td figcaption".split())
REMOVED = frozenset("script style template iframe object embed noscript".split())
FURNITURE = frozenset("nav aside footer header".split())
ASSETS = frozenset("img source video audio track".split())
SET_OFF = frozenset("a button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open one of the second kind, as browsers read pages.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 256


class _Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


class _Tree(HTMLParser):
    """Elements and texts as a tree; end tags without a start are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closed = ENDS.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else set())
        if self.open[-1].tag in closed:
            self.open.pop()
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _origin(url: str) -> str | None:
    try:
        u = urlsplit(url)
        port = f":{u.port}" if u.port is not None and str(u.port) != DEFAULT_PORTS.get(u.scheme) else ""
    except ValueError:
        return None
    return f"{u.scheme}://{(u.hostname or '').lower()}{port}"


def _foreign(node: _Node, origin: str | None) -> bool:
    """An asset of another origin than the page's."""
    src = node.attributes.get("src", "")
    return node.tag in ASSETS and src.lower().startswith(("http://", "https://")) and _origin(src) != origin


def component_text(tag: str, contact: str | None, extension: str | None) -> str | None:
    """What a telephone element shows, which only its attributes tell; None for other elements or without a number."""
    number, more = (contact or "").strip(), (extension or "").strip()
    if tag.lower() != "va-telephone" or not number:
        return None
    return f"{number}, ext. {more}" if more else number


def _text(node: _Node, origin: str | None, dropped: frozenset) -> str:
    out, stack = [], [*reversed(node.children)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in dropped or _foreign(x, origin):
            continue
        shown = component_text(x.tag, x.attributes.get("contact"), x.attributes.get("extension"))
        if shown is not None:
            out.append(f" {shown}")
            continue
        if x.tag in SET_OFF:
            out.append(" ")
        stack += reversed(x.children)
    return "".join(out)


def page_blocks(html: str, url: str) -> list[tuple[str, str]] | None:
    """(tag, text) of the outermost blocks of a page's first main element, else of its first article, in order; None if it has
    neither. Scripts, frames, assets of other origins and the region's furniture are left out."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    origin = _origin(url)
    regions: dict[str, _Node] = {}
    stack = [tree.root]
    while stack and "main" not in regions:
        node = stack.pop()
        if node.tag in ("main", "article"):
            regions.setdefault(node.tag, node)
        stack += reversed([x for x in node.children if not isinstance(x, str) and x.tag not in REMOVED])
    region = regions.get("main") or regions.get("article")
    if region is None:
        return None
    out, dropped = [], REMOVED | FURNITURE
    stack = [*reversed(region.children)]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node.tag in dropped or _foreign(node, origin):
            continue
        if node.tag not in BLOCKS:
            stack += reversed(node.children)
            continue
        text = _text(node, origin, dropped).strip()
        if text:
            out.append((node.tag, text))
    return out


def raw_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, ord, tag, text) of each page's blocks as they stand; a page without a content region has one row with null tag and
    ord -1, one without blocks none. Null HTML is an empty page."""
    spark = pages.sparkSession
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, orders, tags, texts = [], [], [], []
            for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html")), strict=True):
                blocks = page_blocks(html or "", url or "")
                for k, (tag, text) in enumerate([(None, None)] if blocks is None else blocks):
                    ids.append(i)
                    orders.append(-1 if blocks is None else k)
                    tags.append(tag)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(orders, pa.int64()), pa.array(tags, pa.string()), pa.array(texts, pa.string())], names=["id", "ord", "tag", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ord long, tag string, text string")


def shaped_blocks(blocks: DataFrame) -> DataFrame:
    """(id, ord, tag, text, section) from (id, ord, tag, text): canonical texts, empty ones gone; a heading is the section of
    itself and of what follows up to the next."""
    kept = blocks.where("tag IS NOT NULL").withColumn("text", canonical(F.col("text"))).where("text <> ''")
    heading = F.when(F.lower("tag").rlike("^h[1-6]$"), F.col("text"))
    so_far = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("section", F.last(heading, ignorenulls=True).over(so_far))


def whole_texts(blocks: DataFrame) -> DataFrame:
    """(id, text): each page's block texts joined by line ends and made canonical once more: the text that places refer to."""
    listed = blocks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return listed.select("id", canonical(F.array_join("b.text", "\n")).alias("text"))


def extracted(pages: DataFrame, origin: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, fault, n_blocks, text) of each page: fault is no_region or off_origin (its text names a resource elsewhere), else
    null; text is null with a fault. ``origin`` is an expression over ``pages``."""
    blocks = raw_blocks(pages, id_col, url_col, html_col)
    shaped = shaped_blocks(blocks)
    texts = whole_texts(shaped).join(shaped.groupBy("id").agg(F.count("*").alias("n_blocks")), "id")
    lost = blocks.where("ord = -1").select("id", F.lit(True).alias("lost"))
    named = pages.select(F.col(id_col).alias("id"), origin.alias("origin"))
    rows = named.join(texts, "id", "left").join(lost, "id", "left")
    fault = F.when(F.col("lost"), "no_region").when(F.size(off_origin_urls(F.col("text"), F.col("origin"))) > 0, "off_origin")
    return rows.select("id", fault.alias("fault"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.when(fault.isNull(), F.coalesce("text", F.lit(""))).alias("text"))
