"""Transcript parsing: a hidden Markov model recovers roles by Viterbi, then turns are rendered in one form.

A conversation is a sequence of blocks (rows in the order of their turn; lines, for raw transcripts cut by
``transcript_blocks``). Observed of a block: its speaker marker, if any, and features of its lines; hidden: its role. Counts
from labelled rows, a bounded sample of ``TRAIN_ROWS`` of them, smooth a prior in which markers mostly tell the truth and roles
alternate.

No conversation has to fit into a task: rows are sorted by range, so a long one lies in several partitions. For each of its
pieces the best scores from any state before to any state at its end form a small matrix; these are chained in max-plus
algebra (as many rows as partitions), which fixes the states at the pieces' ends, and each piece is decoded between them.

Blocks of one role that follow each other are one turn: its first block opens it, its last closes it, and what the blocks of a
conversation render to is, put together in order, the conversation in its canonical form. ``turns`` does that. Where roles are
given, two models are trained, each on the conversations of one half by hash, and each half is read by the other's, so no
conversation is read by what its own labels taught.

A null id is a conversation of its own; null turns come first, equal turns by hash and text. Null and empty texts are
blocks without features and are rendered empty. Rows that repeat are blocks each. Very long blocks are observed by their ends,
size and line breaks and rendered whole. Extra columns of any name take no part. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import field, small, small_batches, staged

ROLES = ("system", "user", "assistant")
#: Names that speakers go by in front of a colon. Fixed values.
MARKERS = {
    "system": ("system", "instructions", "instruction", "context"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "gpt", "model", "response"),
}
TRAIN_ROWS, TRAIN_SEED = 50_000, 5
SMALL = 50_000

_NAMES = {name: k + 1 for k, role in enumerate(ROLES) for name in MARKERS[role]}
MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*\*|<\|(?:im_start\|>)?|\[)?\s*(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\s*(?:\|>|\]|\*\*)?\s*(?::(?:\*\*)?|(?<=\|>)|(?<=\]))\s*", re.IGNORECASE)

#: Values that each feature takes.
WIDTHS = (len(ROLES) + 1, 8, 4, 2, 2, 2, 2)


def observed(text: str | None) -> tuple[int, ...]:
    """Features of a block: marker (0: none), size, lines, a question, code or a list, an opening in lower case, words that set
    a task."""
    text = text or ""
    found = MARKER.match(text)
    body = text[found.end() :] if found else text
    return (
        _NAMES[found[1].lower()] if found else 0,
        min(7, len(body).bit_length() // 2),
        min(3, body.count("\n").bit_length()),
        int(body.rstrip().endswith("?")),
        int("```" in body or "\n- " in body or "\n* " in body or "\n1." in body),
        int(body[:1].islower()),
        int(body[:60].lower().startswith(("you are", "you must", "act as", "the assistant"))),
    )


class Model:
    """Logarithms of initial, transition and feature probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]) -> None:
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))
        self.emit = [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit]

    def scores(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        """Log probability of each block's features in each role."""
        x = np.array(seen, int).reshape(len(seen), len(WIDTHS))
        return sum(e[:, x[:, k]].T for k, e in enumerate(self.emit))

    def matrix(self, scores: np.ndarray) -> np.ndarray:
        """Best score of the piece from each state before it (the last row: the start) to each state at its end."""
        m = np.vstack([self.step, self.start]) + scores[0]
        for s in scores[1:]:
            m = (m[:, :, None] + self.step[None]).max(axis=1) + s
        return m

    def decode(self, scores: np.ndarray, entry: int | None = None, leave: int | None = None) -> list[int]:
        """The best states, given those before the piece and at its end if they are known; ties to the lower state."""
        v = (self.start if entry is None else self.step[entry]) + scores[0]
        back = []
        for s in scores[1:]:
            w = v[:, None] + self.step
            back.append(w.argmax(axis=0))
            v = w.max(axis=0) + s
        path = [int(v.argmax()) if leave is None else leave]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Counts that stand for what is known before any label: conversations open with system or user, roles alternate, a
    marker names its role nine times in ten, other features say nothing."""
    start = np.array([3.0, 5.0, 2.0])
    step = np.array([[1.0, 8.0, 1.0], [0.2, 1.0, 8.8], [0.2, 8.8, 1.0]])
    marker = np.array([[5.0, *(4.5 if r == k else 0.25 for k in range(len(ROLES)))] for r in range(len(ROLES))])
    return start, step, [marker, *[np.ones((len(ROLES), w)) for w in WIDTHS[1:]]]


def fit(rows: list[tuple]) -> Model:
    """From (conversation, role, features) in order; rows of other roles break the chain."""
    start, step, emit = prior()
    last_key, last = object(), None
    for key, role, seen in rows:
        r = ROLES.index(role) if role in ROLES else None
        if r is not None:
            if key != last_key:
                start[r] += 1
            elif last is not None:
                step[last, r] += 1
            for k, x in enumerate(seen):
                emit[k][r, x] += 1
        last_key, last = key, r
    return Model(start, step, emit)


def ordered(df: DataFrame, conv_col: str, turn_col: str, text_col: str, role_col: str | None) -> DataFrame:
    role = field(role_col).cast("string") if role_col else F.lit(None).cast("string")
    out = df.select(field(conv_col).alias("conv"), field(turn_col).alias("turn"), field(text_col).cast("string").alias("text"), role.alias("given"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    return out.withColumns({"key": key, "tie": F.xxhash64("text"), "half": F.pmod(F.xxhash64(F.lit(TRAIN_SEED + 1), key), F.lit(2)).cast("int")})


def train(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role", half: int | None = None) -> Model:
    """From whole conversations (of one ``half``) of a bounded sample by hash, the first TRAIN_ROWS of its rows."""
    rows = ordered(df, conv_col, turn_col, text_col, role_col).where("given IS NOT NULL")
    rows = rows if half is None else rows.where(F.col("half") == half)
    step = max(1, rows.count() // TRAIN_ROWS)
    picked = rows.withColumn("draw", F.xxhash64(F.lit(TRAIN_SEED), "key")).where(F.pmod("draw", F.lit(step)) == 0)
    # what a block shows is in its first and last characters, its size and line breaks; long texts stay with the executors
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = pa.array([list(observed(t)) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("draw", "key", "turn", "tie", "given")), seen], names=["draw", "key", "turn", "tie", "given", "seen"])

    picked = picked.select("draw", "key", F.col("turn").cast("long").alias("turn"), "tie", "given", "text")
    shown = picked.mapInArrow(run, "draw long, key string, turn long, tie long, given string, seen array<int>")
    got = shown.orderBy("draw", "key", F.asc_nulls_first("turn"), "tie", "given", "seen").limit(TRAIN_ROWS).collect()
    return fit([(r["key"], r["given"], tuple(r["seen"])) for r in got])


def body_of(text: str | None) -> str:
    """The text without its marker and the white space around."""
    text = text or ""
    found = MARKER.match(text)
    return (text[found.end() :] if found else text).strip()


def rendered(role: str, text: str | None, opens: bool = True, closes: bool = True) -> str:
    """A block as a part of its turn."""
    return (f"<|{role}|>\n" if opens else "") + f"{body_of(text)}\n" + ("<|end|>\n" if closes else "")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """(key, part) and its rows, from batches in which they stand together."""
    at, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (now := (r["key"], r["part"])) != at:
                if rows:
                    yield at, rows
                at, rows = now, []
            rows.append(r)
    if rows:
        yield at, rows


def parse_transcripts(df: DataFrame, model: Model | None = None, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role") -> DataFrame:
    """One row for each row of ``df``: conv_col, turn_col, given (its label, if there is a ``role_col``), role (recovered
    without looking at labels), opens and closes (whether the block is the first, the last of a turn), rendered (the block as a
    part of its turn) and nth (its place in the conversation, from 0). ``model``: by default trained on the labels of the other
    half of ``df``, or the prior without them."""
    if model is not None or not role_col:
        models = [model or Model(*prior())] * 2
    else:
        models = [train(df, conv_col, turn_col, text_col, role_col, half=1 - h) for h in (0, 1)]
    small_batches(df.sparkSession)
    rows = ordered(df, conv_col, turn_col, text_col, role_col)
    order = ["key", F.asc_nulls_first("turn"), "tie", "text", "given"]
    rows = staged(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "transcripts")
    sizes = staged(rows.groupBy("key", "part").agg(F.count("*").alias("n")), "transcripts-sizes")
    long_ones = staged(sizes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "transcripts-long")
    in_order = lambda x: x.repartition("key", "part").sortWithinPartitions("key", "part", *order[1:])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part), block in pieces(batches):
            own = models[block[0]["half"]]
            m = own.matrix(own.scores([observed(r["text"]) for r in block]))
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([m.ravel().tolist()])], names=["key", "part", "m"])

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part").reset_index(drop=True)
        ms = [np.array(m).reshape(len(ROLES) + 1, len(ROLES)) for m in pdf["m"]]
        v, back = ms[0][-1], []
        for m in ms[1:]:
            w = v[:, None] + m[:-1]
            back.append(w.argmax(axis=0))
            v = w.max(axis=0)
        leave = [int(v.argmax())]
        for b in reversed(back):
            leave.append(int(b[leave[-1]]))
        leave = leave[::-1]
        return pd.DataFrame({"key": pdf["key"], "part": pdf["part"], "entry": [-1, *leave[:-1]], "leave": leave})

    def decode(block: list[dict]) -> list[int]:
        entry, leave = (None if block[0][c] is None or block[0][c] < 0 else block[0][c] for c in ("entry", "leave"))
        own = models[block[0]["half"]]
        return own.decode(own.scores([observed(r["text"]) for r in block]), entry, leave)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part), block in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), pa.array([decode(block)[0]], pa.int32())], names=["key", "part", "first"])

    by_piece = rows.join(small(long_ones, SMALL), "key", "left_semi")
    bounds = in_order(by_piece).select("key", "part", "half", "text").mapInArrow(matrices, "key string, part int, m array<double>").groupBy("key").applyInPandas(chained, "key string, part int, entry int, leave int")
    bounds = staged(bounds, "transcripts-bounds")
    # the state that a piece's successor starts with tells whether its last turn goes on there
    started = in_order(by_piece.join(small(bounds, SMALL), ["key", "part"])).select("key", "part", "half", "text", "entry", "leave").mapInArrow(firsts, "key string, part int, first int")
    by_part = Window.partitionBy("key").orderBy("part")
    known = started.join(bounds, ["key", "part"]).join(sizes, ["key", "part"])
    known = known.select("key", "part", "entry", "leave", F.lead("first").over(by_part).alias("after"), F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    known = staged(known, "transcripts-known")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in pieces(batches):
            path, entry, after = decode(block), block[0]["entry"], block[0]["after"]
            opens = [now != before for before, now in zip([-1 if entry is None else entry, *path[:-1]], path, strict=True)]
            closes = [*opens[1:], after is None or after != path[-1]]
            roles, start = [ROLES[s] for s in path], block[0]["offset"] or 0
            shown = [rendered(x, r["text"], o, c) for x, r, o, c in zip(roles, block, opens, closes, strict=True)]
            columns = [pa.array([r[c] for r in block], t) for c, t in (("conv", kinds[0]), ("turn", kinds[1]), ("given", pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(roles), pa.array(opens), pa.array(closes), pa.array(shown), pa.array(range(start, start + len(block)), pa.int64())], names=[conv_col, turn_col, "given", "role", "opens", "closes", "rendered", "nth"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("conv", "turn")]
    schema = f"`{conv_col}` {rows.schema['conv'].dataType.simpleString()}, `{turn_col}` {rows.schema['turn'].dataType.simpleString()}, given string, role string, opens boolean, closes boolean, rendered string, nth long"
    whole = in_order(rows.join(small(known, SMALL), ["key", "part"], "left"))
    return whole.select("key", "part", "half", "conv", "turn", "text", "given", "entry", "leave", "after", "offset").mapInArrow(decoded, schema)


def turns(parsed: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, turn_no, role, n_blocks, rendered): the canonical turns of what parse_transcripts gives, in the order of their
    blocks. A turn is one row, as long as its blocks are together."""
    so_far = Window.partitionBy(conv_col).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parsed.withColumn("turn_no", F.sum(F.col("opens").cast("long")).over(so_far) - 1)
    listed = numbered.groupBy(conv_col, "turn_no", "role").agg(F.count("*").alias("n_blocks"), F.array_sort(F.collect_list(F.struct("nth", "rendered"))).alias("parts"))
    return listed.select(conv_col, "turn_no", "role", "n_blocks", F.array_join("parts.rendered", "").alias("rendered"))


def transcript_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, text) from raw transcripts: a block for each line, for parse_transcripts with role_col=None."""
    return df.select(field(id_col).alias("conv_id"), F.posexplode(F.split(F.coalesce(field(text_col), F.lit("")), "\n")).alias("turn", "text"))
