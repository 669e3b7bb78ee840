import hashlib
import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import pii
from quillspark.llm.queries import tokenizer_path

from .test_ngram_join import brute
from .test_pii import brute as spans
from .test_quality import counts


def test_against_brute_force(spark, sf):
    """Each stage's effect is worked out anew from the tables: base quality rule, all pairs of shingle sets, patterns, copies
    within the mix's bounds, the tokenizers library. (With so few labels no threshold is certified.)"""
    documents = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = [i for i, r in documents.items() if (c := counts(r["text"]))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    alone = [i for i, _, component in brute([(i, documents[i]["text"]) for i in good]) if i == component]
    got = Counter()
    library = Tokenizer.from_file(tokenizer_path())
    digests = {}
    for i in alone:
        text = documents[i]["text"]
        text = pii.redacted(text, spans(text))
        ids = library.encode(text, add_special_tokens=False).ids
        digests[i] = (hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), len(ids), hashlib.sha256(text.encode()).hexdigest())
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] += 1
        assert hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] and len(r["ids"]) == 4 * r["n_tokens"]
        if len(spans(documents[r["doc_id"]]["text"])) == 0:
            assert (r["ids_sha256"], r["n_tokens"], r["decoded_sha256"]) == digests[r["doc_id"]]
    assert set(got) <= set(alone) and max(got.values()) == 2
    size = {i: len(re.findall(r"\S+", documents[i]["text"])) for i in alone}
    assert abs(sum(size[i] * n for i, n in got.items()) / sum(size.values()) - 1.5) < 0.1


def test_stages_keep_columns(spark, odd, sf):
    docs = odd.select("doc_id", "text", "lang", "source").selectExpr("*", "cast(length(text) as long) as n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert [(f.name, f.dataType) for f in stage(spark, docs, sf).schema] == [(f.name, f.dataType) for f in docs.schema], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0, name
