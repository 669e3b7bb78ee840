"""What the operators of this subpackage share: scratch tables, Arrow batches of texts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; what it makes of them takes some forty times as much.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch that goes to Python: bounds what a worker holds when texts are long.
BATCH_ROWS = 1024
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
#: Least neighbours of at most so many nodes are broadcast in components.
HUBS = 500_000

_local_root: str | None = None


def field(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or, in local
    mode only, a temporary one where it is unset, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        global _local_root
        root = _local_root = _local_root or tempfile.mkdtemp(prefix="quillspark-")
    return root.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors
    and lets later steps read single columns. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes a staged table that nothing reads any more."""
    path = getattr(df, "_quillspark_path", None)
    if path:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, size: int = 16 << 20) -> DataFrame:
    """``df`` as a table in the shared folder, marked for broadcast if it has at most ``rows`` rows and ``size`` bytes there;
    else for a shuffled join."""
    if getattr(df, "_quillspark_path", None) is None:
        df = staged(df, "side")
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quillspark_path)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(df) if held <= size and df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows and about BATCH_BYTES bytes, unless they are smaller. The
    setting stays: plans are lazy, and Spark reads it when they run."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    known = str(spark.conf.get(BATCH_BYTES_CONF)).rstrip("b")
    if not known.isdigit() or not 0 < int(known) <= BATCH_BYTES:
        spark.conf.set(BATCH_BYTES_CONF, str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], sized: str) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that column ``sized`` (binary) has about SLICE_BYTES in each, one row at least."""
    for batch in batches:
        column, start = batch.column(sized), 0
        total = column.nbytes
        if total <= SLICE_BYTES:
            if batch.num_rows:
                yield batch
            continue
        run = 0
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            if run and run + (n or 0) > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, run = i, 0
            run += n or 0
        yield batch.slice(start)


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[list, list[bytes]], dict]]) -> DataFrame:
    """``df`` (doc_id, text as binary) → rows of ``schema``. ``make`` runs once in each task and returns a function from
    a list of ids and one of texts (null: empty) to a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        work = make()
        for batch in sliced(batches, "text"):
            got = work(batch.column("doc_id").to_pylist(), [x or b"" for x in batch.column("text").to_pylist()])
            out = pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if not isinstance(got[f.name], pa.Array) else got[f.name] for f in arrow], schema=arrow)
            for at in range(0, out.num_rows, 1 << 14):
                yield out.slice(at, 1 << 14)
        del work
        pa.default_memory_pool().release_unused()  # the worker serves later tasks too

    return df.mapInArrow(run, schema)


def id_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that map_texts reads, whatever else ``df`` has."""
    return df.select(field(id_col).alias("doc_id"), field(text_col).cast("binary").alias("text"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, component): the smallest node of each component, for
    every node that stands in an edge of two different nodes. Alternates the large-star and small-star steps (each joins the
    edges with the least neighbour of a node, an aggregate that combines before the shuffle), in a number of rounds that
    grows with the logarithm of the longest chain; each round is a table in the shared folder. The least neighbours are a table
    of their own too, broadcast if it is small; else both sides of the join are dealt anew, so that Spark can split a hub's edges."""

    def least(e: DataFrame) -> DataFrame:
        return staged(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), label)

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = least(both)
        large = both.join(small(nearest, HUBS), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b"), label)  # no more rows than edges; the small star drops repeats
        dropped(nearest)
        # small star: a > b holds for every edge here, so b stands for the neighbours at most a
        nearest = least(large)
        near = large.join(small(nearest, HUBS), "a")
        tight = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        nxt = staged(tight.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
        dropped(nearest)
        dropped(large)
        dropped(now)
        now, after = nxt, mark(nxt)
        if after == before:
            break
        before = after
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
