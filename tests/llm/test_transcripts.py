import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import transcripts as tr


def test_markers():
    for text, role, body in [("User: hi", 2, "hi"), ("  **Assistant:** yes", 3, "yes"), ("<|system|> be kind", 1, "be kind"), ("### Human: x", 2, "x"), ("[bot] y", 3, "y"), ("Usable: no", 0, "Usable: no"), ("A: 4", 3, "4"), ("a word", 0, "a word"), (None, 0, ""), ("", 0, "")]:
        assert (tr.observed(text)[0], tr.body_of(text)) == (role, body), text


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    model = tr.Model(rng.random(3), rng.random((3, 3)), [rng.random((3, w)) for w in tr.WIDTHS])
    for n in range(1, 6):
        scores = rng.normal(size=(n, 3))
        value = lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(s[x] for s, x in zip(scores, p, strict=True))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=n), key=value)
        assert tuple(model.decode(scores)) == best
        assert model.matrix(scores)[-1].max() == pytest.approx(value(best))


def test_pieces_agree_with_the_whole(spark):
    """A conversation that lies in many partitions is decoded as one task would decode it."""
    rng = random.Random(2)
    texts = ["User: a?", "Assistant: b", "plain words", "you are kind", "longer " * 9, "", "x\ny\nz", "what?"]
    rows = [(1, t, rng.choice(texts)) for t in range(2000)] + [(c, t, rng.choice(texts)) for c in range(2, 40) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    model = tr.Model(*tr.prior())
    got = {(r["conv_id"], r["turn"]): (r["role"], r["opens"], r["closes"], r["rendered"], r["nth"]) for r in tr.parse_transcripts(df, model, role_col=None).collect()}
    by_conv, whole = {}, {}
    for c, t, x in sorted(rows):
        by_conv.setdefault(c, []).append((t, x))
    for c, blocks in by_conv.items():
        path = model.decode(model.scores([tr.observed(x) for _, x in blocks]))
        roles = [tr.ROLES[s] for s in path]
        assert [got[c, t][0] for t, _ in blocks] == roles
        assert [got[c, t][1] for t, _ in blocks] == [a != b for a, b in zip([None, *roles], roles, strict=False)]
        assert [got[c, t][2] for t, _ in blocks] == [a != b for a, b in zip(roles, [*roles[1:], None], strict=False)]
        assert [got[c, t][4] for t, _ in blocks] == list(range(len(blocks)))
        whole[c] = "".join(got[c, t][3] for t, _ in blocks)
    turns = {}
    for r in tr.turns(tr.parse_transcripts(df, model, role_col=None)).collect():
        turns.setdefault(r["conv_id"], []).append((r["turn_no"], r["rendered"], r["role"]))
    for c, text in whole.items():
        ts = sorted(turns[c])
        assert "".join(x for _, x, _ in ts) == text and [n for n, _, _ in ts] == list(range(len(ts)))
        assert all(x.count("<|end|>") == 1 and x.startswith(f"<|{role}|>\n") for _, x, role in ts)


def test_held_out_accuracy(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    half = F.xxhash64("conv_id") % 2 == 0
    model = tr.train(conversations.where(half))
    got = tr.parse_transcripts(conversations.where(~half), model).collect()
    assert sum(r["role"] == r["given"] for r in got) > 0.95 * len(got)
    assert all(r["rendered"].startswith(f"<|{r['role']}|>\n") == r["opens"] and r["rendered"].endswith("\n<|end|>\n") == r["closes"] for r in got)
    # the query's own way: each half is read by what the other's labels taught
    got = tr.parse_transcripts(conversations).collect()
    assert sum(r["role"] == r["given"] for r in got) > 0.95 * len(got)


def test_raw_transcripts(spark):
    df = spark.createDataFrame([(7, "System: be brief\nUser: hello?\nhow are you\nAssistant: fine")], "doc_id long, text string")
    got = sorted(tr.parse_transcripts(tr.transcript_blocks(df), role_col=None).collect(), key=lambda r: r["turn"])
    assert [r["role"] for r in got][:2] == ["system", "user"] and got[-1]["role"] == "assistant"
    assert "".join(r["rendered"] for r in got).startswith("<|system|>\nbe brief\n<|end|>\n<|user|>\nhello?\n")


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (1, 1, "robot", ""), (1, 1, "robot", ""), (1, None, "user", "x" * 10_000), (2, 0, "assistant", "A: b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("part", F.lit(1))
    got = tr.parse_transcripts(df).collect()
    assert len(got) == 6 and {r["role"] for r in got} <= set(tr.ROLES)
    assert tr.parse_transcripts(df.where("false")).count() == 0


def test_null_and_empty_ids_are_conversations_of_their_own(spark):
    df = spark.createDataFrame([(None, 0, "User: a"), ("", 0, "User: b"), (None, 1, "Assistant: c"), ("", 1, "User: d")], "conv_id string, turn long, text string")
    got = {r["conv_id"]: r["k"] for r in tr.turns(tr.parse_transcripts(df, role_col=None)).groupBy("conv_id").agg(F.count("*").alias("k")).collect()}
    assert got == {None: 2, "": 1}
