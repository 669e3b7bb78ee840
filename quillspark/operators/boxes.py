"""From places in a page's text to boxes on the rendered page, and boxes that adjoin on a line put together.

Everything is expressions: offsets are a window over the items of a page, the map from text to page is affine, and boxes of one
range are folded in order of their tops, since each line's extent decides whether the next box still belongs to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a line's height: how far two boxes on it may be apart, and how far their tops. Fixed values.
MERGE_GAP, SAME_LINE = 0.5, 0.5


def item_spans(items: DataFrame, page: str = "page", order: str = "ord", text: str = "text") -> DataFrame:
    """Adds start and end: where each item stands in its page's text, items joined by single spaces. An item without text (null)
    is an empty slot and has no span."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    before = F.sum(size + 1).over(Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)).cast("long")
    return items.withColumn("start", F.when(F.col(text).isNotNull(), start)).withColumn("end", F.when(F.col(text).isNotNull(), start + size))


def composed(outer: Sequence[Column], inner: Sequence[Column]) -> list[Column]:
    """The affine map (a, b, c, d, e, f) that does ``inner`` first, then ``outer``."""
    a, b, c, d, e, f = outer
    out = []
    for x, y, moved in ((inner[0], inner[1], False), (inner[2], inner[3], False), (inner[4], inner[5], True)):
        out += [a * x + c * y + (e if moved else 0), b * x + d * y + (f if moved else 0)]
    return out


def merged(boxes: Column) -> Column:
    """Boxes (x, y, width, height) that stand on one line and adjoin are one, from the top, then the left."""
    kind = "struct<x: double, y: double, width: double, height: double>"
    in_order = F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"], b["x"], b["width"], b["height"]))), lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["width"].alias("width"), b["height"].alias("height")))
    none = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("line"))

    def step(state: Column, box: Column) -> Column:
        line = state["line"]
        same = (F.abs(line["y"] - box["y"]) < line["height"] * SAME_LINE) & (box["x"] <= line["x"] + line["width"] + line["height"] * MERGE_GAP)
        left, top = F.least(line["x"], box["x"]), F.least(line["y"], box["y"])
        right, bottom = F.greatest(line["x"] + line["width"], box["x"] + box["width"]), F.greatest(line["y"] + line["height"], box["y"] + box["height"])
        wider = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))
        go_on = F.struct(state["done"].alias("done"), wider.alias("line"))
        start = F.struct(F.when(line.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(line))).alias("done"), box.alias("line"))
        return F.when(F.coalesce(same, F.lit(False)), go_on).otherwise(start)

    return F.aggregate(in_order, none, step, lambda s: F.when(s["line"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))


def range_boxes(items: DataFrame, ranges: DataFrame, viewport: Sequence[Column | float], page: str = "page") -> DataFrame:
    """(page, range, nth, x, y, width, height): the boxes of each range (page, range, start, end) of a page's text, from the page's items
    (page, ord, text, transform: six numbers, width). An item that a range covers in part is boxed in proportion to its
    characters; ranges that cover nothing have no row."""
    view = [v if isinstance(v, Column) else F.lit(float(v)) for v in viewport]
    spans = item_spans(items, page).where("end > start")
    hit = spans.join(ranges.select(page, "range", F.col("start").alias("_from"), F.col("end").alias("_to")), page).where("start < _to AND end > _from")
    low, high, length = F.greatest("start", "_from"), F.least("end", "_to"), F.col("end") - F.col("start")
    a, b, c, d, e, f = composed(view, [F.get("transform", F.lit(i)) for i in range(6)])
    tall, wide = F.hypot(c, d), F.col("width") * F.hypot(view[0], view[1])
    box = F.struct((e + wide * (low - F.col("start")) / length).alias("x"), (f - tall).alias("y"), (wide * (high - low) / length).alias("width"), tall.alias("height"))
    lines = hit.where(low < high).select(page, "range", box.alias("b")).groupBy(page, "range").agg(merged(F.collect_list("b")).alias("lines"))
    return lines.select(page, "range", F.posexplode("lines").alias("nth", "b")).select(page, "range", "nth", "b.*")
