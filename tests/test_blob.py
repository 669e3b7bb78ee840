"""Vectors as raw floats and texts as files: round trips, every check, and what a task reads."""

import json
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.sources import blob as B


@pytest.fixture(scope="module")
def artifact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blob") / "v")
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000 - 500).alias("id"), F.array(*[(F.col("id") * (k + 1) % 17 + 1).cast("float") for k in range(5)]).alias("vector"))
    B.write_vectors(df, path, "1", "m", 5)
    return path, {r["id"]: list(r["vector"]) for r in df.collect()}


def test_round_trip(spark, artifact):
    path, want = artifact
    got = B.read_vectors(spark, path, "1", "m", unit=False).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(1000)) and [r["id"] for r in got] == sorted(want)
    assert all(list(r["vector"]) == want[r["id"]] for r in got)
    for r in B.read_vectors(spark, "file://" + path, "1", "m").collect():
        v = np.array(want[r["id"]])
        assert np.allclose(r["vector"], v / np.linalg.norm(v), atol=1e-6)
    assert sum(os.path.getsize(f"{path}/{n}") for n in os.listdir(path) if n.endswith(".f32")) == 1000 * 5 * 4


def test_tasks_read_their_range_alone(spark, artifact):
    path, _ = artifact
    reader = B.VectorReader({"path": path, "version": "1", "model": "m", "rangeBytes": 20 * 64})
    parts = reader.partitions()
    assert sum(p.rows for p in parts) == 1000 and max(p.rows for p in parts) <= 64 and len(parts) > 10
    read = [b for p in parts[3:5] for b in reader.read(p)]
    assert sum(b.num_rows for b in read) == sum(p.rows for p in parts[3:5])
    df = B.read_vectors(spark, path, "1", "m", rangeBytes=20 * 64)
    assert df.rdd.getNumPartitions() == len(parts) and df.count() == 1000


def edited(path, tmp_path, **changes):
    """A copy of the artifact with another manifest."""
    other = tmp_path / f"c{len(list(tmp_path.iterdir()))}"
    other.mkdir()
    for n in os.listdir(path):
        if not n.startswith("manifest"):
            os.link(f"{path}/{n}", other / n)
    (other / "manifest.json").write_text(json.dumps(B.read_manifest(path) | changes))
    return str(other)


def fault(spark, path, version="1", model="m"):
    with pytest.raises(B.ArtifactFault) as e:
        B.read_vectors(spark, path, version, model)
    return e.value.code


def test_checks_come_in_order(spark, artifact, tmp_path):
    path, _ = artifact
    assert fault(spark, path, "2", "other") == "version" and fault(spark, path, "1", "other") == "model"
    for dim in (0, -1, 2.5, "5", True, None):
        assert fault(spark, edited(path, tmp_path, dim=dim)) == "shape"
    assert fault(spark, edited(path, tmp_path, parts=None)) == "shape"
    assert fault(spark, edited(path, tmp_path, dim=4)) == "length" and fault(spark, edited(path, tmp_path, n=999)) == "length"
    gone = edited(path, tmp_path)
    os.unlink(f"{gone}/{B.read_manifest(path)['parts'][0]['name']}.f32")
    assert fault(spark, gone) == "length"
    assert fault(spark, edited(path, tmp_path, version="0", model="x", dim=0)) == "version"


def test_passages_with_vectors(spark, artifact):
    path, want = artifact
    p = spark.createDataFrame([(i, "https://a/" if i % 2 else "HTTPS://B/") for i in want], "id long, url string")
    assert B.open_corpus(spark, p, path, "1", "m").count() == 1000
    for rows, code in ((p.where("id <> 3"), "length"), (p.withColumn("url", F.when(F.col("id") != 3, F.col("url"))), "url"), (p.withColumn("url", F.lit("http://a")), "url")):
        with pytest.raises(B.ArtifactFault) as e:
            B.open_corpus(spark, rows, path, "1", "m")
        assert e.value.code == code


def test_odd_vectors(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "id long, vector array<float>")
    for k, rows in enumerate(([(1, [1.0])], [(1, None)], [(None, [1.0, 2.0])], [(1, [1.0, None])])):
        with pytest.raises(PySparkException, match="shape"):
            B.write_vectors(df(*rows), str(tmp_path / f"odd{k}"), "1", "m", 2)
    B.write_vectors(df((1, [1.0, 0.0]), (2, [0.0, 0.0])), str(tmp_path / "zero"), "1", "m", 2)
    with pytest.raises(PySparkException, match="zero"):
        B.read_vectors(spark, str(tmp_path / "zero"), "1", "m").collect()
    B.write_vectors(df((1, [1.0, 0.0])).where("false"), str(tmp_path / "none"), "1", "m", 2)
    assert B.read_vectors(spark, str(tmp_path / "none"), "1", "m").count() == 0
    with pytest.raises(PySparkException, match="already"):
        B.write_vectors(df((1, [1.0, 0.0])), str(tmp_path / "zero"), "1", "m", 2)
    assert B.read_vectors(spark, str(tmp_path / "zero"), "1", "m", unit=False).count() == 2


def test_what_no_manifest_names_is_not_read(spark, artifact, tmp_path):
    path, _ = artifact
    other = edited(path, tmp_path)
    for kind in ("f32", "i64"):
        (tmp_path / os.path.basename(other) / f"part-left-behind.{kind}").write_bytes(b"x" * 40)
    assert B.read_vectors(spark, other, "1", "m").count() == 1000


def test_texts(spark, tmp_path):
    path = tmp_path / "texts"
    df = spark.createDataFrame([("a.ics", "one\r\ntwo\r\n"), ("b", None), ("c-1", "é")], "name string, text string")
    B.write_texts(df.repartition(3), str(path))
    B.write_texts(df, "file:" + str(path))  # once more: the same files
    assert sorted(os.listdir(path)) == ["_SUCCESS", "a.ics", "b", "c-1"]
    assert (path / "a.ics").read_bytes() == b"one\r\ntwo\r\n" and (path / "b").read_bytes() == b"" and json.loads((path / "_SUCCESS").read_text()) == {"files": 3, "octets": 12}
    for name in ("../x", "", None, "a/b", ".hidden"):
        with pytest.raises(PySparkException, match="fit for a file"):
            B.write_texts(spark.createDataFrame([(name, "x")], "name string, text string"), str(tmp_path / "bad"))
    assert not (tmp_path / "bad" / "_SUCCESS").exists()


def test_texts_in_folders(spark, tmp_path, monkeypatch):
    """Files of several folders are all read, in any number of batches, without what a lost task left; flat ones and unfinished ones aren't."""
    path = str(tmp_path / "dealt")
    rows = [(f"{k}.ics", "é\r\n" * (k % 7)) for k in range(200)]
    B.write_texts(spark.createDataFrame(rows, "name string, text string").repartition(3), path, 20)
    B.write_texts(spark.createDataFrame(rows[:50], "name string, text string"), path, 20)  # once more: the same files
    assert len([d for d in os.listdir(path) if os.path.isdir(f"{path}/{d}")]) == 20
    with open(f"{path}/0/5.ics.{'0' * 32}.tmp", "wb") as f:
        f.write(b"left behind")
    out = B.read_texts(spark, path)
    assert out.rdd.getNumPartitions() == 2
    assert sorted((r["name"], bytes(r["content"]).decode()) for r in out.collect()) == sorted(rows)
    B.write_texts(spark.createDataFrame(rows[:3], "name string, text string"), str(tmp_path / "flat"))
    with pytest.raises(PySparkException, match="in folders"):
        B.read_texts(spark, str(tmp_path / "flat")).collect()
