"""Helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch that goes to Python; bytes of text that a task handles at once, what it makes of them being many times as much.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 1024, 4 << 20, 1 << 20

_local_root: str | None = None


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows and about BATCH_BYTES bytes, unless they are smaller. The setting stays:
    plans are lazy, and Spark reads it when they run."""
    for conf, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        known = str(spark.conf.get(conf)).lower().rstrip("b")
        if not known.isdigit() or not 0 < int(known) <= most:
            spark.conf.set(conf, str(most))


def sliced(batches: Iterator[pa.RecordBatch], sized: str | Callable[[pa.RecordBatch], list[int]]) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of column ``sized``, or the rows whose sizes it gives, have about SLICE_BYTES in each, one row
    at least."""
    for batch in batches:
        start = held = 0
        for i, n in enumerate(sized(batch) if callable(sized) else pa.compute.binary_length(batch.column(sized)).to_pylist()):
            if held and held + (n or 0) > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; whatever Python makes of it gets batches of bounded size."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt anew over as many tasks as a shuffle has, two a core at least: a file of few row groups is else read by few tasks, which
    do all the work on its rows as well."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir (in local mode a temporary one where it is unset, as in tests); what is written
    there goes when the application ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        global _local_root
        root = _local_root = _local_root or tempfile.mkdtemp(prefix="quillspark-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to a scratch path and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def small_side(df: DataFrame, rows: int = 10_000, size: int = 16 << 20) -> DataFrame:
    """``df`` as a table in the shared folder, marked for broadcast if it has at most ``rows`` rows and ``size`` bytes there; else for a
    shuffled join, both sides of which are dealt anew. Its plan runs once."""
    if getattr(df, "_quillspark_path", None) is None:
        df = staged(df, "side")
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quillspark_path)
    held = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(df) if held <= size and df.limit(rows + 1).count() <= rows else df
