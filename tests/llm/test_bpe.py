import hashlib
import random

import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe
from quillspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def same(library, df, got):
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in df.collect())
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_as_the_library(library, odd, documents):
    for df in (odd, documents):
        same(library, df, bpe.encode_texts(df, tokenizer_path()))


def test_lexicon_size_is_without_effect(documents):
    few = bpe.encode_texts(documents, tokenizer_path(), bpe.build_lexicon(documents, tokenizer_path(), words=5))
    many = bpe.encode_texts(documents, tokenizer_path())
    assert sorted(r["ids_sha256"] for r in few.collect()) == sorted(r["ids_sha256"] for r in many.collect())


def test_random_texts(library):
    codec = bpe.Codec(tokenizer_path(), bpe.compile_lexicon([], None))
    rng = random.Random(5)
    pool = "aabbcd eE'st 0½٣é世́ \x1c\x85​\n\t-_.<|>😀ªʰⅧ"
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randrange(40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode([text]) == [b"".join(i.to_bytes(4, "little") for i in want)], repr(text)


def test_lexicon_is_minimal_and_exact():
    rng = random.Random(6)
    words = {bytes(rng.choices(b"abc", k=rng.randrange(1, 7))) for _ in range(400)}
    blob = bpe.compile_lexicon(words, lambda w: list(w))
    lexicon = bpe.opened(blob)
    asked = [*words, *(bytes(rng.choices(b"abcd", k=rng.randrange(8))) for _ in range(2000)), b""]
    for w, got in zip(asked, lexicon.find(asked), strict=True):
        assert got == (b"".join(b.to_bytes(4, "little") for b in w) if w in words else None)
    # as many states as there are different sets of endings
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(lexicon.finals) == len(endings)


def test_long_pre_tokens(library):
    codec = bpe.Codec(tokenizer_path(), bpe.compile_lexicon([], None))
    text = "".join(random.Random(7).choices("abcdefghij", k=60_000))
    coded = codec.encode([text])[0]
    assert coded == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
    assert codec.decode(coded) == text


def test_empty_table(none):
    assert bpe.encode_texts(none, tokenizer_path()).count() == 0
