"""Artifacts, canonical JSON, signatures, encryption, stored states and backups."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import records as J
from quillspark.sources import artifact as A


def each(spark, texts, column):
    return [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_canonical_json_and_signatures(spark):
    a, b = '{"b": [1, {"d": "é", "c": null}], "a": 2.5}', '{"a":2.5,"b":[1,{"c":null,"d":"é"}]}'
    assert each(spark, [a, b, "no json", None], J.canonical_json) == [b, b, None, None]
    want = hmac.new(b"k" * 80, f'{{"name":"n\\"1","payload":{b}}}'.encode(), hashlib.sha256).hexdigest()
    assert each(spark, [a, b], lambda t: J.signed(F.lit('n"1'), t, b"k" * 80)) == [want, want]
    assert each(spark, ["x"], lambda t: J.hmac_sha256(t, b"key")) == [hmac.new(b"key", b"x", hashlib.sha256).hexdigest()]


def test_encryption(spark):
    key, iv = b"0123456789abcdef", F.lit(bytearray(range(12)))
    blob = lambda t: J.encrypted(t, key, iv, J.bound_to(F.lit("s"), F.lit("r"), F.lit(1), F.lit(2)))
    back = lambda t, *parts: J.decrypted(blob(t), key, J.bound_to(*map(F.lit, parts))).cast("string")
    assert each(spark, ["hidden", ""], lambda t: back(t, "s", "r", 1, 2)) == ["hidden", ""]
    assert each(spark, ["hidden"], lambda t: back(t, "s", "r", 2, 2)) == [None]
    assert bytes(each(spark, ["x"], blob)[0])[:12] == bytes(range(12))


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "a"],), (["z"],), ([None],), ([],), (None,)], "v array<string>")
    assert [r["x"] for r in df.select(J.known_list(F.col("v"), ["a", "b"]).alias("x")).collect()] == [["a", "b"], None, None, None, [], None]


def test_stored_tasks(spark):
    state = {"schemaVersion": 1, "tasks": {"a": {"status": "done"}, "b": {"status": "snoozed", "snoozeUntil": "2024-02-30", "notes": "n"}, "c": {"status": 5}, "d": 7, "e": {"status": "snoozed", "snoozeUntil": "2024-02-29"}, "f": {"status": "snoozed"}}}
    got = each(spark, [json.dumps(state), json.dumps(state | {"schemaVersion": 2}), "x", '{"schemaVersion": 1, "tasks": []}', None], J.stored_tasks)
    assert {k: tuple(v) for k, v in got[0].items()} == {"a": ("done", None, None), "b": (None, "n", None), "e": ("snoozed", None, "2024-02-29"), "f": ("snoozed", None, None)}
    assert got[1:] == [None] * 4


def test_backups(spark):
    good = {"backupSchema": 1, "appVersion": "1.2.0", "createdAt": 5, "stores": {"profile": {"eaos": "2024-02-29"}, "timeline-state": None, "calendar-sync": {"schemaVersion": 1, "exclusions": {"taskIds": ["t"], "categories": []}}}}
    stores = good["stores"]
    cases = [
        (good, None), (good | {"backupSchema": 2}, "newer"), (good | {"backupSchema": 1.5}, "invalid"), (good | {"more": 1}, "invalid"), (good | {"appVersion": "1.02.0"}, "invalid"),
        (good | {"stores": stores | {"profile": {"eaos": "2024-02-30"}}}, "profile"), (good | {"appVersion": "9.0.0", "stores": stores | {"profile": None}}, "newer"),
        (good | {"stores": stores | {"timeline-state": {"schemaVersion": 1, "tasks": {"u": {"status": "done"}}}}}, "timeline"), (good | {"stores": stores | {"timeline-state": {"schemaVersion": 1, "tasks": {"t": {"status": "done"}}}}}, None),
        (good | {"stores": stores | {"calendar-sync": {"schemaVersion": 1, "exclusions": {"taskIds": ["u"], "categories": []}}}}, "calendar"), (good | {"stores": {"profile": {}}}, "invalid"),
    ]
    got = each(spark, [json.dumps(c) for c, _ in cases] + ["no json"], lambda t: J.backup_fault(t, "1.2.0", ["t"], ["c"]))
    assert got == [w for _, w in cases] + ["invalid"]


def test_artifacts(spark, tmp_path):
    passages = spark.createDataFrame([("a", "https://x"), ("b", "HTTPS://y")], "id string, url string")
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "id string, vector array<float>")
    path = str(tmp_path / "one")
    A.write_artifact(passages, vectors, path, "m", "1.0.2")
    got = {r["id"]: [round(x, 6) for x in r["vector"]] for r in A.open_artifact(spark, path, "m", "1.0.2").collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.0, 1.0]}
    assert A.artifact_fault(spark, path, "other", "1.0.2") == "model" and A.artifact_fault(spark, path, "m", "1.0.3") == "version"
    with pytest.raises(ValueError, match="go together"):
        A.write_artifact(passages, vectors.where("id = 'a'"), str(tmp_path / "two"), "m", "1")
    bad = str(tmp_path / "three")
    A.write_artifact(passages.withColumn("url", F.lit("http://x")), vectors, bad, "m", "1")
    assert A.artifact_fault(spark, bad, "m", "1") == "url"


def test_paged_texts(spark):
    items = spark.createDataFrame([(1, 1, 0, "a  ﬁne-", True), (1, 1, 1, "text", False), (1, 2, 0, "next", True), (2, 1, 0, "", True), (2, 2, 0, None, False)], "doc int, page int, ord int, text string, ends_line boolean")
    blocks, whole = A.paged_texts(items)
    assert {tuple(r) for r in blocks.collect()} == {(1, 1, "a finetext"), (1, 2, "next"), (2, 1, ""), (2, 2, "")}
    assert {tuple(r) for r in whole.collect()} == {(1, "a finetext next", False), (2, "", True)}
