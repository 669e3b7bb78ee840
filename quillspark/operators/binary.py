"""What raw bytes of files carry: names of PDF dictionaries and header segments of JPEG pictures.

Names are read by expressions over the bytes as Latin-1 text. A walk along segments, each of which says where the next one starts,
has no expression; it runs as Arrow batches of files, in time that grows with a file's size: where a walk comes upon a place that
another one has passed, it ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------------------------------------------------

#: A slash and all up to white space or a delimiter of PDF.
NAME = r"/[^\x00\t\n\f\r ()<>\[\]{}/%]*"
#: Names by which a file acts on its own, and those that hide dictionaries from this scan.
ACTIVE = (
    "/3D", "/AA", "/EF", "/EmbeddedFile", "/EmbeddedFiles", "/FileAttachment", "/GoToE", "/GoToR", "/ImportData", "/JS", "/JavaScript", "/Launch", "/Movie", "/OpenAction", "/Rendition",
    "/RichMedia", "/Screen", "/Sound", "/SubmitForm", "/XFA", "/ObjStm", "/XRef", "/XRefStm",
)
#: Names that tell of a file's makers.
METADATA = ("/CreationDate", "/CreatorInfo", "/Info", "/LastModified", "/Metadata", "/ModDate", "/PieceInfo", "/RC")
#: Application segments that a picture needs (0, 2 and 14 of the sixteen from 0xE0 on), the comment, and what ends a header.
NEEDED, APPLICATION, COMMENT, ENDS = (0xE0, 0xE2, 0xEE), range(0xE0, 0xF0), 0xFE, (0xDA, 0xD9)

_PICTURE = re.compile(b"(?=\xff\xd8\xff)")


def unescaped(name: Column) -> Column:
    """A name with its escapes (# and two hexadecimal digits) read, each once."""
    parts = F.split(name, "#(?=[0-9A-Fa-f]{2})")
    read = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substr(p, F.lit(3))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(read, ""))


def names(content: Column) -> Column:
    """The different names in a file's bytes, unescaped; null of null."""
    raw = F.decode(content, "ISO-8859-1")
    return F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(NAME), F.lit(0)), unescaped))


def names_among(content: Column, listed: tuple[str, ...]) -> Column:
    """Those of the ``listed`` names that a file has, once each, in order."""
    return F.array_sort(F.array_intersect(names(content), F.array(*map(F.lit, listed))))


def header_segments(data: bytes) -> list[tuple[int, int, int]]:
    """(place, marker, size) of the segments in the headers of all pictures in ``data``, each once: from a picture's first byte to its
    image data, an end, a byte that is no marker, a size that can't be, or the end of the file. A last segment may be cut short."""
    passed, out = set(), []
    for m in _PICTURE.finditer(data):
        at = m.start() + 2
        while at not in passed and at + 3 < len(data) and data[at] == 0xFF and data[at + 1] not in ENDS:
            passed.add(at)
            size = data[at + 2] << 8 | data[at + 3]
            out.append((at, data[at + 1], size))
            if size < 2:
                break
            at += 2 + size
    return sorted(out)


def segments(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, at, marker, size) of the header segments of the pictures in each file's bytes; a null file has none."""
    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for i, data in enumerate(batch.column("content")):
                found = header_segments(data.as_py() or b"")
                if found:
                    at, marker, size = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([i] * len(found))), pa.array(at, pa.int64()), pa.array(marker, pa.int32()), pa.array(size, pa.int32())], names=["id", "at", "marker", "size"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, at long, marker int, size int")


def refused_segment(marker: Column) -> Column:
    """What a segment that no picture needs is called: APP and its number, or COM; null for others."""
    other = marker.between(APPLICATION[0], APPLICATION[-1]) & ~marker.isin(*NEEDED)
    return F.when(marker == COMMENT, "COM").when(other, F.concat(F.lit("APP"), (marker - APPLICATION[0]).cast("string")))


def metadata(files: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, found) for each different file id: the names and segments that tell of a file's makers, once each, in order."""
    listed = files.select(F.col(id_col).alias("id"), F.explode_outer(names_among(F.col(content_col).cast("binary"), METADATA)).alias("one"))
    parts = segments(files, id_col, content_col).select("id", refused_segment(F.col("marker")).alias("one")).where("one IS NOT NULL")
    return listed.unionByName(parts).groupBy("id").agg(F.array_sort(F.collect_set("one")).alias("found"))
