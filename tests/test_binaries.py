"""Names and segments in bytes, boxes on pages: planted files, broken ones, and plain walks."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import binary as B
from quillspark.operators import boxes as X


def one(spark, data, column):
    return spark.createDataFrame([(bytearray(data),)], "c binary").select(column.alias("x")).first()["x"]


def plain_names(data):
    raw = data.decode("latin-1")
    return {re.sub("#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), n) for n in re.findall(r"/[^\x00\t\n\f\r ()<>\[\]{}/%]*", raw)}


def test_names(spark):
    data = b"<</JS(x)/J#61vaScript/JSON/#4a#53/Launch#2/AA\x00/X#23#34\xff/EF%/EmbeddedFil#65s>>/"
    assert set(one(spark, data, B.names(F.col("c")))) == plain_names(data) >= {"/JS", "/JavaScript", "/JSON", "/Launch#2", "/"}
    assert one(spark, data, B.names_among(F.col("c"), B.ACTIVE)) == ["/AA", "/EF", "/EmbeddedFiles", "/JS", "/JavaScript"]
    assert one(spark, b"", B.names_among(F.col("c"), B.ACTIVE)) == []
    rng = random.Random(1)
    rows = [(i, bytearray(bytes(rng.choices(b"/#J%S4 15(aA\x00\xe9", k=200)))) for i in range(100)]
    for r in spark.createDataFrame(rows, "i int, c binary").select("c", B.names(F.col("c")).alias("n")).collect():
        assert set(r["n"]) == plain_names(bytes(r["c"])) and len(r["n"]) == len(set(r["n"]))


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def plain_segments(data):
    """Every walk from every start, without memory of other walks."""
    found = set()
    for start in range(len(data)):
        if data[start : start + 3] == b"\xff\xd8\xff":
            at = start + 2
            while at + 3 < len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
                size = data[at + 2] * 256 + data[at + 3]
                found.add((at, data[at + 1], size))
                if size < 2:
                    break
                at += 2 + size
    return sorted(found)


def test_segments_planted_nested_and_truncated():
    inner = b"\xff\xd8" + segment(0xE5, b"in") + b"\xff\xd9"
    data = b"x" + b"\xff\xd8" + segment(0xE0, b"JFIF") + segment(0xE1, inner) + segment(0xFE, b"me") + b"\xff\xda\xff\xe3\x00\x09" + b"y\xff\xd8" + segment(0xE4, b"z" * 9)[:7]
    assert [(m, n) for _, m, n in B.header_segments(data)] == [(0xE0, 6), (0xE1, len(inner) + 2), (0xE5, 4), (0xFE, 4), (0xE4, 11)]
    assert B.header_segments(b"") == B.header_segments(b"\xff\xd8\xff") == [] and B.header_segments(b"\xff\xd8\xff\xe1\x00\x00rest") == [(2, 0xE1, 0)]
    assert B.header_segments(b"\xff\xd8\xffx00") == [] or B.header_segments(b"\xff\xd8\xffx00")[0][1] == ord("x")


def test_segments_against_all_walks():
    rng = random.Random(2)
    for _ in range(500):
        data = bytes(rng.choices([0xFF, 0xD8, 0xE1, 0xFE, 0xDA, 0, 1, 3, 5], k=rng.randrange(0, 80)))
        assert B.header_segments(data) == plain_segments(data)


def test_many_pictures_are_walked_once():
    """Every start leads into one long chain; its segments are passed once."""
    chain = b"".join(segment(0xE1, b"\xff\xd8") for _ in range(30_000))
    assert len(B.header_segments(b"\xff\xd8" + chain)) == 30_000


def test_metadata_rows(spark):
    data = b"/Info /M#65tadata /Information \xff\xd8" + segment(0xED, b"") + segment(0xEE, b"") + segment(0xFE, b"") + b"\xff\xd9"
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"clean"))], "id int, content binary")
    assert {r["id"]: r["found"] for r in B.metadata(df).collect()} == {1: ["/Info", "/Metadata", "APP13", "COM"], 2: [], 3: []}
    assert B.metadata(df.where("false")).count() == 0


def plain_lines(boxes):
    lines = []
    for x, y, w, h in sorted(boxes, key=lambda b: (b[1], b[0], b[2], b[3])):
        if lines:
            a, b, c, d = lines[-1]
            if abs(b - y) < d / 2 and x <= a + c + d / 2:
                left, top = min(a, x), min(b, y)
                lines[-1] = (left, top, max(a + c, x + w) - left, max(b + d, y + h) - top)
                continue
        lines.append((x, y, w, h))
    return lines


def test_lines_of_boxes(spark):
    rng = random.Random(3)
    kind = "array<struct<x: double, y: double, width: double, height: double>>"
    rows = [(i, [(float(rng.randrange(0, 40)), float(rng.randrange(0, 12)), float(rng.randrange(0, 9)), float(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 12))]) for i in range(200)]
    rows.append((999, [(0.0, 0.0, 4.0, 2.0)] * 3))
    got = {r["i"]: [tuple(b) for b in r["m"]] for r in spark.createDataFrame(rows, f"i int, b {kind}").select("i", X.merged(F.col("b")).alias("m")).collect()}
    assert got == {i: plain_lines(b) for i, b in rows}


def test_ranges_on_a_page(spark):
    items = spark.createDataFrame(
        [("p", 1, "Hello", [10.0, 0.0, 0.0, 10.0, 100.0, 700.0], 50.0), ("p", 2, None, None, None), ("p", 3, "world", [10.0, 0.0, 0.0, 10.0, 155.0, 700.0], 50.0), ("p", 4, "below", [10.0, 0.0, 0.0, 10.0, 100.0, 680.0], 40.0), ("p", 5, "", [1.0] * 6, 1.0)],
        "page string, ord int, text string, transform array<double>, width double",
    )
    assert [(r["start"], r["end"]) for r in X.item_spans(items).orderBy("ord").collect()] == [(0, 5), (None, None), (7, 12), (13, 18), (19, 19)]
    ranges = spark.createDataFrame([("p", "a", 0, 18), ("p", "b", 1, 2), ("p", "none", 5, 7), ("q", "c", 0, 9)], "page string, range string, start int, end int")
    got = {(r["range"], r["nth"]): (r["x"], r["y"], r["width"], r["height"]) for r in X.range_boxes(items, ranges, (2, 0, 0, -2, 0, 1500)).collect()}
    assert got == {("a", 0): (200.0, 80.0, 210.0, 20.0), ("a", 1): (200.0, 120.0, 80.0, 20.0), ("b", 0): (220.0, 80.0, 20.0, 20.0)}
