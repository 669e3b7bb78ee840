"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field adds spans that patterns miss: its nodes are the tokens with digits, ``@`` or ``+``
and those that repeat the local part of an address; neighbours share a chain potential, and tokens of one document that
repeat or resemble each other (the same word, the same digits, the same last seven digits, an address and its local part)
a skip potential. Tokens of base spans are observed; loopy message passing carries their labels to the rest, and a node whose
belief in a kind reaches ``SURE`` gives a span. Equal keys are linked one to the next and to the first observed one, so links
grow as tokens do. All other tokens count as outside, which cuts the chain. The field runs on each document that has nodes,
whether or not a pattern matched there.

The potentials are fit by penalised pseudo-likelihood on the base labels of at most ``TRAIN_ROWS`` tokens from about
``TRAIN_DOCS`` documents (a bounded sample by hash of the id), around a prior that lets linked tokens agree. Patterns label
only what they match, so a token that resembles an observed one but isn't matched says nothing and isn't trained on; and as
the form of a token was all that the patterns saw, its evidence is held to ``FORM`` either way, which one observed token that
it resembles outweighs. Where the sample has no personal data, nothing is added.

Secrets (a long run of hexadecimal digits or base64 letters that a word for a key stands before) are a pattern beside the
base ones; they aren't among the spans but have a count of their own, and ``redact`` takes them away too.

Null and empty texts have no spans. Rows with a null id are served like others but never sampled. Repeated rows are
searched each for itself; an empty table gives an empty one; extra columns of any name stay out of the search. Very long
texts are searched whole: links and messages grow as the tokens do and are passed in blocks. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, id_and_bytes, map_texts, sliced, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)
TRAIN_DOCS, TRAIN_ROWS, TRAIN_SEED = 4000, 20_000, 11
SURE, ROUNDS, DAMPING = 0.8, 20, 0.5
#: Most that a token's form says for or against a kind, and what agreeing with a like token counts beforehand.
FORM, AGREE = 3.0, 6.0
MIN_KEY = 5
#: Links whose messages are worked out at once.
LINKS = 1 << 15

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No start within a run of digits can do better than the run's own start, so only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, MARK, TOKEN = re.compile("[0-9]"), re.compile("[0-9@+]"), re.compile(r"\S+")
TRIM = ".,;:!?()[]{}\"'<>"
#: A word for a key, a sign that gives it, and at least twenty letters of it.
SECRET = re.compile(r"(?i:\b(?:api[_-]?key|access[_-]?key|auth|key|passw(?:or)?d|pwd|secret|token)\b)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?([A-Za-z0-9+/_=-]{20,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain: looks around each @."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(floor, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind, then start."""
    out = [(0, *x) for x in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def secret_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of secrets that have a digit."""
    return [m.span(1) for m in SECRET.finditer(text) if DIGIT.search(m[1])]


# ---- the graph of a document -----------------------------------------------------------------------------------------


def nodes_of(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit, @ or +, and those equal to the local part of a token with @; trimmed of punctuation."""
    found, end = [], 0
    for m in MARK.finditer(text):
        if m.start() >= end:
            start = m.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            end = TOKEN.match(text, m.start()).end()
            found.append((start, end))
    locals_ = {k for s, e in found if "@" in text[s:e] and len(k := text[s:e].strip(TRIM).split("@")[0].casefold()) >= MIN_KEY}
    if locals_:
        marked = set(found)
        found = sorted(marked | {m.span() for m in TOKEN.finditer(text) if m[0].strip(TRIM).casefold() in locals_})
    out = []
    for s, e in found:
        own = text[s:e]
        left = len(own) - len(own.lstrip(TRIM))
        right = len(own.rstrip(TRIM))
        if left < right:
            out.append((s + left, s + right))
    return out


def keys_of(token: str) -> set[str]:
    """What a token has in common with tokens that should have its label."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    low, out = token.casefold(), set()
    if "@" in low:
        local = low.split("@")[0]
        out |= {f"w{x}" for x in (low, local) if len(x) >= MIN_KEY}
    elif any(c.isalpha() for c in low):
        out |= {f"w{low}"} if len(low) >= MIN_KEY else set()
    elif len(digits) >= 4:
        out.add(f"d{digits}")
        if len(digits) >= 7:
            out.add(f"t{digits[-7:]}")
    return out


class Spans:
    """Spans (kind, start, end), those of a kind in order and apart: which kinds a stretch meets takes two searches a kind."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.by_kind: dict[int, tuple[list[int], list[int]]] = {}
        for kind, start, end in sorted(spans):
            starts, ends = self.by_kind.setdefault(kind, ([], []))
            starts.append(start)
            ends.append(end)

    def met(self, start: int, end: int) -> list[int]:
        out = []
        for kind, (starts, ends) in self.by_kind.items():
            i = bisect_right(ends, start)
            if i < len(starts) and starts[i] < end:
                out.append(kind)
        return out


#: Words before a token that speak of what it is, by kind.
CUES = (
    frozenset("mail email contact write reply".split()), frozenset("ip ips host server address addr gateway".split()),
    frozenset("card cards visa mastercard credit debit account".split()), frozenset("call phone tel telephone ring mobile fax cell dial".split()),
)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w\n]*$")
#: Characters before a token in which the word before it is looked for.
BESIDE = 32


def word_before(text: str, at: int) -> str:
    """The word that stands before a place in its line, in lower case; empty without one near."""
    m = _WORD_BEFORE.search(text[max(0, at - BESIDE) : at])
    return m[1].lower() if m else ""


def features(token: str, before: str, word: str = "") -> int:
    """Bits of a token's form and of the word before it."""
    digits = sum("0" <= c <= "9" for c in token)
    letters = any(c.isalpha() for c in token)
    at = token.find("@")
    tests = (
        True, at >= 0, at >= 0 and "." in token[at:], digits == 0, 1 <= digits <= 3, 4 <= digits <= 8, 9 <= digits <= 12, 13 <= digits <= 19, digits > 19,
        token.count(".") == 3, token.count(".") > 3, token.startswith("+") or before == "+", "-" in token, letters, letters and digits > 0, "(" in token or before == "(", "_" in token or "%" in token, len(token) >= 20,
        *(word in cues for cues in CUES),
    )
    return sum(1 << k for k, x in enumerate(tests) if x)


N_FEATURES = 18 + len(CUES)


class Graph:
    """Nodes of a document with their forms, observed labels (0: none), chain and skip links."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        self.nodes = nodes_of(text)
        self.form = [features(text[s:e], text[s - 1 : s] if s else "", word_before(text, s)) for s, e in self.nodes]
        self.base = Spans(base)
        self.seen = [min(self.base.met(s, e), default=-1) + 1 for s, e in self.nodes]
        self.chain = [(i, i + 1) for i in range(len(self.nodes) - 1) if not text[self.nodes[i][1] : self.nodes[i + 1][0]].strip(TRIM + " \t\n\r\x0b\x0c")]
        by_key: dict[str, list[int]] = defaultdict(list)
        for i, (s, e) in enumerate(self.nodes):
            for k in keys_of(text[s:e]):
                by_key[k].append(i)
        links = set()
        for same in by_key.values():
            first = next((i for i in same if self.seen[i]), None)
            links.update(zip(same, same[1:], strict=False))
            if first is not None:
                links.update((min(first, i), max(first, i)) for i in same if i != first)
        self.skip = sorted(links)


class Field:
    """Weights: form by label, chain label by label, skip label by label."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip

    def beliefs(self, g: Graph) -> np.ndarray:
        """Each node's distribution over labels, by loopy message passing in logarithms with damping."""
        m = len(LABELS)
        bits = (np.array(g.form)[:, None] >> np.arange(N_FEATURES)) & 1
        own = bits @ self.unary
        own[:, 1:] = np.clip(own[:, 1:] - own[:, :1], -FORM, FORM)
        own[:, 0] = 0.0
        seen = np.array(g.seen)
        own[seen > 0] = -50.0
        own[seen > 0, seen[seen > 0]] = 0.0
        links = np.array([*g.chain, *g.skip], np.int64).reshape(-1, 2)
        if len(links):
            # each link once forward, once back: tables 0 and 1 are the chain's, 2 is that of skips
            a, b = np.r_[links[:, 0], links[:, 1]], np.r_[links[:, 1], links[:, 0]]
            tables, skip = np.stack([self.chain, self.chain.T, self.skip]), np.arange(len(links)) >= len(g.chain)
            kind = np.r_[np.where(skip, 2, 0), np.where(skip, 2, 1)]
            back = np.r_[len(links) : 2 * len(links), 0 : len(links)]
            message = np.zeros((len(a), m))
            for _ in range(ROUNDS):
                total = own.copy()
                np.add.at(total, b, message)
                new = np.empty_like(message)
                for at in range(0, len(a), LINKS):
                    part = slice(at, at + LINKS)
                    out = (total[a[part]] - message[back[part]])[:, :, None] + tables[kind[part]]
                    top = out.max(axis=1, keepdims=True)
                    new[part] = top[:, 0] + np.log(np.exp(out - top).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                step = np.abs(new - message).max()
                message = DAMPING * message + (1 - DAMPING) * new
                if step < 1e-3:
                    break
            np.add.at(own, b, message)
        own -= own.max(axis=1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that the field adds to the base ones, none of which it overlaps."""
        g = Graph(text, base)
        if all(x > 0 for x in g.seen):  # also where there are no nodes
            return []
        p = self.beliefs(g)
        label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
        joined, out = set(g.chain), []
        for i, (s, e) in enumerate(g.nodes):
            if label[i] and not g.seen[i]:
                if out and out[-1][0] == label[i] - 1 and (i - 1, i) in joined and out[-1][2] == g.nodes[i - 1][1]:
                    out[-1] = (out[-1][0], out[-1][1], e)
                else:
                    out.append((int(label[i]) - 1, s, e))
        return out


# ---- training --------------------------------------------------------------------------------------------------------


def training_rows(df: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(at, label, form, before, after, linked): tokens of a bounded sample of documents with their base labels and those of
    their neighbours (-1: none) and, by label, how many linked tokens have it."""
    step = max(1, rows // TRAIN_DOCS)

    def make():
        def work(ids: list, texts: list[bytes]) -> dict:
            out: dict = {c: [] for c in ("at", "label", "form", "before", "after", "linked")}
            for doc_id, raw in zip(ids, texts, strict=True):
                text = raw.decode("utf-8", "replace")
                g = Graph(text, base_spans(text))
                before, after = {j: g.seen[i] for i, j in g.chain}, {i: g.seen[j] for i, j in g.chain}
                linked = [[0] * len(LABELS) for _ in g.nodes]
                for i, j in g.skip:
                    linked[i][g.seen[j]] += 1
                    linked[j][g.seen[i]] += 1
                for i, (s, _) in enumerate(g.nodes):
                    if not g.seen[i] and any(linked[i][1:]):
                        continue
                    out["at"].append(hash((doc_id, s)) & 0x7FFFFFFFFFFFFFF)
                    out["label"].append(g.seen[i])
                    out["form"].append(g.form[i])
                    out["before"].append(before.get(i, -1))
                    out["after"].append(after.get(i, -1))
                    out["linked"].append(linked[i])
            return out

        return work

    sample = df.where(field(id_col).isNotNull() & (F.pmod(F.xxhash64(F.lit(TRAIN_SEED), field(id_col)), F.lit(step)) == 0))
    return map_texts(id_and_bytes(sample, id_col, text_col), "at long, label int, form int, before int, after int, linked array<int>", make)


def fit(rows: list, rounds: int = 300, ridge: float = 1e-3) -> Field | None:
    """Weights of greatest penalised pseudo-likelihood, by accelerated gradient steps; None without personal data."""
    m = len(LABELS)
    y = np.array([r["label"] for r in rows], int)
    if not len(y) or not (y > 0).any():
        return None
    x = ((np.array([r["form"] for r in rows])[:, None] >> np.arange(N_FEATURES)) & 1).astype(float)
    one = np.vstack([np.eye(m), np.zeros(m)])
    before, after = one[[r["before"] for r in rows]], one[[r["after"] for r in rows]]
    linked = np.array([r["linked"] for r in rows], float)
    linked /= np.maximum(1, linked.sum(axis=1, keepdims=True))
    target = np.eye(m)[y]
    prior = [np.zeros((N_FEATURES, m)), np.zeros((m, m)), AGREE * np.eye(m)]
    w, ahead = [p.copy() for p in prior], [p.copy() for p in prior]
    for k in range(rounds):
        u, c, s = ahead
        z = x @ u + before @ c + after @ c.T + linked @ s
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        g = (p / p.sum(axis=1, keepdims=True) - target) / len(y)
        ds = linked.T @ g
        grads = [x.T @ g, before.T @ g + g.T @ after, (ds + ds.T) / 2]
        new = [a - 0.5 * (d + ridge * (a - q)) for a, d, q in zip(ahead, grads, prior, strict=True)]
        ahead = [n + k / (k + 3) * (n - o) for n, o in zip(new, w, strict=True)]
        w = new
    return Field(*w)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """The field for ``df``."""
    got = training_rows(df, df.select(field(id_col)).count(), id_col, text_col).orderBy("at", "form", "label").limit(TRAIN_ROWS).collect()
    return fit(got)


# ---- over tables -----------------------------------------------------------------------------------------------------


def text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(df: DataFrame, model: Field | None | str = "train", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; n_email, n_ip, n_card, n_phone of the base spans, the SHA-256 of their list, the list of all spans
    (kind:start:end, by kind as listed, then start, joined by commas), how many these are, how many secrets there are, and
    whether there is any of them."""
    field_ = train(df, id_col, text_col) if isinstance(model, str) else model

    def make():
        def work(ids: list, texts: list[bytes]) -> dict:
            out: dict = {"doc_id": ids} | {c: [] for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_secret", "private")}
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(x[0] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(text_of(base).encode()).hexdigest())
                spans = base + (field_.added(text, base) if field_ else [])
                secrets = secret_spans(text)
                out["spans"].append(text_of(spans))
                out["n_spans"].append(len(spans))
                out["n_secret"].append(len(secrets))
                out["private"].append(bool(spans or secrets))
            return out

        return work

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long, private boolean"
    return map_texts(id_and_bytes(df, id_col, text_col), schema, make)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span and secret replaced by its kind in brackets; what overlaps is one span of the first's kind."""
    out, at = [], 0
    for s, e, kind in sorted([*((s, e, KINDS[k]) for k, s, e in spans), *((s, e, "secret") for s, e in secret_spans(text))]):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, model: Field | None | str = "train", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with all spans replaced in ``text_col``; null texts stay null, other columns as they are."""
    field_ = train(df, id_col, text_col) if isinstance(model, str) else model
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            at, new = names.index(text_col), []
            for raw in batch.column(at).to_pylist():
                if raw is not None:
                    raw = raw.decode("utf-8", "replace")
                    base = base_spans(raw)
                    raw = redacted(raw, base + (field_.added(raw, base) if field_ else []))
                new.append(raw)
            columns = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.withColumn(text_col, field(text_col).cast("binary")).mapInArrow(run, df.schema)
