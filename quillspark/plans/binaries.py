"""Queries over bytes of files and geometry of pages: names and segments in files made of the documents, boxes made of order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import binary as B
from ..operators import boxes as X
from ..operators.common import table

#: Dictionaries put before the documents by turns: names whole, escaped, longer than a listed one, broken off.
OBJECTS = ("<</S/JavaScript/JS(x)>>", "<</AA 1 0 R/J#53on/J#53>>", "<</Type#20/Em#62edded#46ile/EF[/XFA]>>", "<</JSON/Launch#2/ModDate/Info 3 0 R>>", "/OpenAction/#52C/PieceInfo%/Meta#64ata", "(no name)")
#: Characters of a document in one segment: at most four bytes each, and a segment has 65,533.
PIECE = 16_000


def _file(text: Column, key: Column) -> Column:
    """Bytes of a file: a dictionary, the text itself, and a picture whose header's segments are the pieces of the text."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    marker = lambda i: F.hex(F.lit(224) + (key + i) % 17 + F.when((key + i) % 17 == 16, 14).otherwise(0))
    part = F.transform(pieces, lambda p, i: F.concat(F.lit("FF"), marker(i), F.lpad(F.hex(F.octet_length(p) + 2), 4, "0"), F.hex(p)))
    picture = F.unhex(F.concat(F.lit("FFD8"), F.array_join(part, ""), F.lit("FFDA00FFE1FFFE")))
    return F.concat(F.get(F.array(*map(F.lit, OBJECTS)), (key % len(OBJECTS)).cast("int")).cast("binary"), text.cast("binary"), picture)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _file(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("content"))


def active_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names by which each file acts on its own."""
    return _files(spark, sf_dir).select(F.col("id").alias("doc_id"), F.array_join(B.names_among(F.col("content"), B.ACTIVE), ",").alias("found"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells of a file's makers, by names and by the segments of its picture."""
    return B.metadata(_files(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.array_join("found", ",").alias("found"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments of each kind all files have, and the bytes in them."""
    return B.segments(_files(spark, sf_dir)).groupBy("marker").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


VIEW = (1.5, 0.0, 0.0, -1.5, 10.0, 1200.0)


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pages: their lines as text items in lines of three, some without text, and two ranges of each page's text."""
    k = F.col("l_linenumber")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    text = F.when(F.col("l_quantity") % 7 != 3, F.concat(F.col("l_returnflag"), F.repeat(F.lit("x"), (F.col("l_quantity") % 9).cast("int")), F.col("l_linestatus")))
    high = F.lit(8.0) + F.col("l_suppkey") % 3
    transform = F.array(high, F.lit(0.0), F.lit(0.0), high, (F.col("l_partkey") % 5 + 3) * (k % 3) * 8.0, 700.0 - F.floor(k / 3) * 6.0 - F.col("l_suppkey") % 2)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), nth.alias("ord"), text.alias("text"), transform.alias("transform"), (F.col("l_quantity") % 11 * 2.0 + 1).alias("width"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    cut = F.explode(F.array(F.struct(F.lit("head").alias("range"), F.lit(2).alias("start"), F.lit(9).alias("end")), F.struct(F.lit("rest").alias("range"), F.lit(6).alias("start"), F.lit(1000).alias("end"))))
    return items, pages.select("page", cut.alias("r")).select("page", "r.*")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the ranges on their pages, put together by lines."""
    out = X.range_boxes(*_lines(spark, sf_dir), VIEW)
    return out.select("page", "range", "nth", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


QUERIES = {f"binaries_{f.__name__}": f for f in (active_names, metadata, segments, boxes)}

_OBJECTS = "[" + ", ".join(f"'{x}'" for x in OBJECTS) + "][1 + doc_id % 6]"
_NAMES = r"""named AS (SELECT doc_id, unnest(regexp_extract_all({object} || coalesce(text, ''), '/[^\x00\t\n\f\r ()<>\[\]{{}}/%]*')) AS name FROM documents),
parts AS (SELECT doc_id, string_split_regex(regexp_replace(name, '#([0-9A-Fa-f]{{2}})', chr(57345) || '\1', 'g'), chr(57345)) AS p FROM named),
names AS (SELECT DISTINCT doc_id, p[1] || array_to_string(list_transform(p[2:], lambda x: chr(('0x' || x[1:2])::INT) || x[3:]), '') AS name FROM parts)""".format(object=_OBJECTS)
_PIECES = f"places AS (SELECT doc_id, i, strlen(substring(text, i * {PIECE} + 1, {PIECE})) + 2 AS size, (doc_id + i) % 17 AS m FROM (SELECT doc_id, text, unnest(range(0, (length(text) + {PIECE - 1}) // {PIECE})) AS i FROM documents))"
_LIST = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"

ORACLES = {
    "binaries_active_names": f"WITH {_NAMES} SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (name IN {_LIST(B.ACTIVE)}), '') AS found FROM (SELECT doc_id, name FROM names UNION SELECT doc_id, '' FROM documents) GROUP BY doc_id",
    "binaries_metadata": f"WITH {_NAMES}, {_PIECES}, found AS (SELECT doc_id, name FROM names WHERE name IN {_LIST(B.METADATA)} UNION SELECT doc_id, CASE WHEN m = 16 THEN 'COM' ELSE 'APP' || m END FROM places WHERE m NOT IN (0, 2, 14)) SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS found FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id",
    "binaries_segments": f"WITH {_PIECES} SELECT (CASE WHEN m = 16 THEN 254 ELSE 224 + m END)::INT AS marker, count(*) AS n, sum(size)::BIGINT AS bytes FROM places GROUP BY 1",
    "binaries_boxes": """WITH RECURSIVE items AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, CASE WHEN l_quantity % 7 <> 3 THEN 2 + (l_quantity % 9)::INT END AS size, 8.0::DOUBLE + l_suppkey % 3 AS h,
  (l_partkey % 5 + 3) * (l_linenumber % 3) * 8.0::DOUBLE AS e, 700.0::DOUBLE - l_linenumber // 3 * 6 - l_suppkey % 2 AS f, l_quantity % 11 * 2.0::DOUBLE + 1 AS w FROM lineitem),
spans AS (SELECT *, coalesce(sum(coalesce(size, 0) + 1) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM items),
hit AS (SELECT page, range, greatest(s, a) AS lo, least(s + size, b) AS hi, * EXCLUDE (page, range) FROM spans, (VALUES ('head', 2, 9), ('rest', 6, 1000)) AS r(range, a, b) WHERE size > 0 AND s < b AND s + size > a AND page IN (SELECT o_orderkey FROM orders)),
boxes AS (SELECT page, range, 1.5 * e + 10 + w * 1.5 * (lo - s) / size AS x, 1200 - 1.5 * f - 1.5 * h AS y, w * 1.5 * (hi - lo) / size AS wd, 1.5 * h AS ht FROM hit WHERE lo < hi),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page, range ORDER BY y, x, wd, ht) AS k FROM boxes),
fold AS (SELECT page, range, k, 0 AS nth, x, y, wd, ht FROM numbered WHERE k = 1 UNION ALL
  SELECT n.page, n.range, n.k, CASE WHEN same THEN nth ELSE nth + 1 END, CASE WHEN same THEN least(x0, n.x) ELSE n.x END, CASE WHEN same THEN least(y0, n.y) ELSE n.y END,
    CASE WHEN same THEN greatest(x0 + w0, n.x + n.wd) - least(x0, n.x) ELSE n.wd END, CASE WHEN same THEN greatest(y0 + h0, n.y + n.ht) - least(y0, n.y) ELSE n.ht END
  FROM (SELECT f.page, f.range, f.k, f.nth, f.x AS x0, f.y AS y0, f.wd AS w0, f.ht AS h0, abs(f.y - n.y) < 0.5 * f.ht AND n.x <= f.x + f.wd + 0.5 * f.ht AS same, n FROM fold f JOIN numbered n ON n.page = f.page AND n.range = f.range AND n.k = f.k + 1) j)
SELECT page, range, nth::INT AS nth, round(arg_max(x, k), 6) AS x, round(arg_max(y, k), 6) AS y, round(arg_max(wd, k), 6) AS width, round(arg_max(ht, k), 6) AS height FROM fold GROUP BY page, range, nth""",
}
