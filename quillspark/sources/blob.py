"""Spark data sources in files of their own form: vectors as flat 32-bit floats beside a manifest, and texts as one file a row.

``quill_vectors`` writes parts of raw little-endian floats and of 64-bit ids; a part counts once the manifest names it, so what lost
or repeated tasks leave behind is never read. A reader opens the manifest alone, checks it in a fixed order, and deals byte ranges
of whole vectors; no task reads more than its range. ``quill_texts`` writes each row's text under its name, by moving a finished file
into place, so a repeated task writes the same file again.

Files are reached through Arrow's file systems (local and shared folders, HDFS, S3, GCS by their URIs).
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StringType, StructField, StructType

MANIFEST = "manifest.json"
#: Bytes of vectors that a task reads at most, and that it holds at once.
RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: Rows in a batch that a writer takes at once.
BATCH_ROWS = 8192
#: Folders of texts that a task reads.
TASK_FOLDERS = 16


class ArtifactFault(ValueError):
    """What is wrong with an artifact: ``code`` is version, model, shape, length, url or zero."""

    def __init__(self, code: str) -> None:
        super().__init__(f"the artifact's {code} doesn't fit")
        self.code = code

    def __reduce__(self):
        return ArtifactFault, (self.code,)


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def read_manifest(path: str) -> dict:
    files, root = opened(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def write_file(files: arrow_fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file beside its place and moves it there."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(beside) as f:
        f.write(data)
    files.move(beside, path)


def checked(manifest: dict, sizes: list[int] | None, version: str, model: str) -> None:
    """Raises for the first that doesn't fit: version, model, shape, then the length of each part (``sizes``: bytes that it has)."""
    if manifest.get("version") != version:
        raise ArtifactFault("version")
    if manifest.get("model") != model:
        raise ArtifactFault("model")
    dim, parts = manifest.get("dim"), manifest.get("parts")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not whole(dim) or dim <= 0 or not isinstance(parts, list) or not all(whole(p.get("rows")) and p["rows"] >= 0 for p in parts):
        raise ArtifactFault("shape")
    if sizes is not None and (sizes != [p["rows"] * dim * 4 for p in parts] or sum(p["rows"] for p in parts) != manifest.get("n")):
        raise ArtifactFault("length")


@dataclass
class Range(InputPartition):
    """Vectors of one part: from ``row`` on, ``rows`` of them; ``first`` is the number of the part's first vector."""

    name: str
    row: int
    rows: int
    first: int


class VectorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.unit = options["path"], str(options.get("unit", "true")).lower() == "true"
        manifest = read_manifest(self.path)
        files, root = opened(self.path)
        checked(manifest, None, options["version"], options["model"])
        found = files.get_file_info([f"{root}/{p['name']}.f32" for p in manifest["parts"]]) if manifest["parts"] else []
        checked(manifest, [max(0, x.size or 0) for x in found], options["version"], options["model"])
        self.dim, self.parts = manifest["dim"], manifest["parts"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[Range]:
        step, out, first = max(1, self.range_bytes // (4 * self.dim)), [], 0
        for p in self.parts:
            out += [Range(p["name"], at, min(step, p["rows"] - at), first) for at in range(0, p["rows"], step)]
            first += p["rows"]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        files, root = opened(self.path)
        step = max(1, CHUNK_BYTES // (4 * self.dim))
        with files.open_input_file(f"{root}/{partition.name}.f32") as floats, files.open_input_file(f"{root}/{partition.name}.i64") as names:
            for at in range(partition.row, partition.row + partition.rows, step):
                n = min(step, partition.row + partition.rows - at)
                v = np.frombuffer(floats.read_at(4 * self.dim * n, 4 * self.dim * at), "<f4").reshape(n, self.dim)
                ids = np.frombuffer(names.read_at(8 * n, 8 * at), "<i8")
                if self.unit:
                    size = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
                    if not (size > 0).all():
                        raise ArtifactFault("zero")
                    v = (v / size).astype(np.float32)
                ends = pa.array(np.arange(0, (n + 1) * self.dim, self.dim, dtype=np.int32))
                vectors = pa.ListArray.from_arrays(ends, pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(partition.first + np.arange(at, at + n)), pa.array(ids), vectors], names=["ord", "id", "vector"])


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    least: int | None


class VectorWriter(DataSourceArrowWriter):
    """Rows (ord, id, vector); ord isn't read, parts stand in the order of their first ids."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = dict(options), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, root = opened(self.options["path"])
        files.create_dir(root, recursive=True)
        name, dim, rows, least = f"part-{uuid.uuid4().hex}", int(self.options["dim"]), 0, None
        with files.open_output_stream(f"{root}/{name}.f32") as floats, files.open_output_stream(f"{root}/{name}.i64") as names:
            for batch in iterator:
                vectors, ids = batch.column("vector"), batch.column("id")
                sizes = vectors.value_lengths()
                if vectors.null_count or ids.null_count or vectors.flatten().null_count or pa.compute.any(pa.compute.not_equal(sizes, dim)).as_py():
                    raise ArtifactFault("shape")
                floats.write(vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                names.write(ids.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                if batch.num_rows:
                    least = ids[0].as_py() if least is None else least
                    rows += batch.num_rows
        return Part(name, rows, least)

    def commit(self, messages: list[Part | None]) -> None:
        files, root = opened(self.options["path"])
        files.create_dir(root, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.least)
        manifest = {"version": self.options["version"], "model": self.options["model"], "dim": int(self.options["dim"]), "n": sum(m.rows for m in parts), "parts": [{"name": m.name, "rows": m.rows} for m in parts]}
        if not self.overwrite and files.get_file_info(f"{root}/{MANIFEST}").type != arrow_fs.FileType.NotFound:
            raise FileExistsError("there is an artifact already")
        write_file(files, f"{root}/{MANIFEST}", json.dumps(manifest).encode())

    def abort(self, messages: list[Part | None]) -> None:
        files, root = opened(self.options["path"])
        for m in messages:
            for kind in ("f32", "i64") if m is not None else ():
                files.delete_file(f"{root}/{m.name}.{kind}")


class Vectors(DataSource):
    """Options: path, version, model; to write also dim; to read also unit (vectors made one long, true if unset) and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "quill_vectors"

    def schema(self) -> StructType:
        return StructType([StructField("ord", LongType()), StructField("id", LongType()), StructField("vector", ArrayType(FloatType()))])

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(dict(self.options), overwrite)


def write_vectors(vectors: DataFrame, path: str, version: str, model: str, dim: int) -> None:
    """Writes (id long, vector) as an artifact in the order of ids: each part has a range of them. Raises for a null, or a vector of another
    length, and where an artifact stands already."""
    vectors.sparkSession.dataSource.register(Vectors)
    rows = vectors.select(F.lit(0).cast("long").alias("ord"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    rows.repartitionByRange("id").sortWithinPartitions("id").write.format("quill_vectors").options(path=path, version=version, model=model, dim=dim).mode("append").save()


def read_vectors(spark: SparkSession, path: str, version: str, model: str, **options: object) -> DataFrame:
    """(ord, id, vector) of an artifact, vectors made one long; raises ArtifactFault for what doesn't fit, as the plan is made; for a
    vector of zeros as it is read."""
    spark.dataSource.register(Vectors)
    checked(read_manifest(path), None, version, model)
    VectorReader({"path": path, "version": version, "model": model} | options)
    return spark.read.format("quill_vectors").options(path=path, version=version, model=model, **options).load()


def open_corpus(spark: SparkSession, passages: DataFrame, path: str, version: str, model: str) -> DataFrame:
    """``passages`` (id, url, ...) with their vectors, behind all checks in their order: those of the vectors, that as many passages are
    there, then that every url is https."""
    vectors = read_vectors(spark, path, version, model)
    n = read_manifest(path)["n"]
    state = passages.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.lower("url").startswith("https://"), F.lit(False))).alias("odd")).first()
    if state["n"] != n:
        raise ArtifactFault("length")
    if state["odd"]:
        raise ArtifactFault("url")
    return passages.join(vectors, "id")


# ---- texts -----------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: int
    octets: int


class TextWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.folders = options["path"], int(options.get("folders", 0))

    def write(self, iterator: Iterator) -> Written:
        files, root = opened(self.path)
        for folder in [f"{root}/{k}" for k in range(self.folders)] or [root]:
            files.create_dir(folder, recursive=True)
        n = octets = 0
        for row in iterator:
            if row["name"] is None or not re.fullmatch(r"[\w-][\w.-]*", row["name"]):
                raise ValueError("a name isn't fit for a file")
            data = (row["text"] or "").encode()
            write_file(files, f"{root}/{zlib.crc32(row['name'].encode()) % self.folders}/{row['name']}" if self.folders else f"{root}/{row['name']}", data)
            n, octets = n + 1, octets + len(data)
        return Written(n, octets)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        known = [m for m in messages if m is not None]
        write_file(files, f"{root}/_SUCCESS", json.dumps({"files": sum(m.files for m in known), "octets": sum(m.octets for m in known)} | ({"folders": self.folders} if self.folders else {})).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """What was written stays, as a later run writes the same; without _SUCCESS it doesn't count."""


@dataclass
class Folders(InputPartition):
    """Folders ``start`` up to ``end``, exclusive."""

    start: int
    end: int


class TextReader(DataSourceReader):
    """Each task lists its own folders, so the names of all files are never in one place."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        files, root = opened(self.path)
        with files.open_input_stream(f"{root}/_SUCCESS") as f:
            self.folders = json.loads(f.read()).get("folders", 0)
        if not self.folders:
            raise ValueError("the texts aren't in folders")

    def partitions(self) -> list[Folders]:
        return [Folders(k, min(self.folders, k + TASK_FOLDERS)) for k in range(0, self.folders, TASK_FOLDERS)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        for k in range(partition.start, partition.end):
            names, contents, held = [], [], 0
            for x in files.get_file_info(arrow_fs.FileSelector(f"{root}/{k}", allow_not_found=True)):
                if re.search("[.][0-9a-f]{32}[.]tmp$", x.base_name):
                    continue
                with files.open_input_stream(x.path) as f:
                    contents.append(f.read())
                names.append(x.base_name)
                held += len(contents[-1])
                if held >= CHUNK_BYTES or len(names) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])
                    names, contents, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])


class Texts(DataSource):
    """Options: path; to write also folders (none if unset). Rows (name, text): a file each; read: (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "quill_texts"

    def schema(self) -> StructType:
        return StructType([StructField("name", StringType()), StructField("content", BinaryType())])

    def reader(self, schema: StructType) -> TextReader:
        return TextReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TextWriter:
        return TextWriter(dict(self.options))


def write_texts(texts: DataFrame, path: str, folders: int = 0) -> None:
    """Writes each (name, text) as the file ``path``/name in UTF-8, line ends as they are, and _SUCCESS with their number once all are
    there; a null text is an empty file. With ``folders`` files are dealt into so many numbered folders by their names, which
    read_texts reads side by side."""
    texts.sparkSession.dataSource.register(Texts)
    texts.select("name", "text").write.format("quill_texts").option("path", path).option("folders", folders).mode("append").save()


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of all files that write_texts dealt into folders."""
    spark.dataSource.register(Texts)
    return spark.read.format("quill_texts").option("path", path).load()
