"""From raw documents to token ids: quality rules, near duplicates, personal data, source mix, BPE.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of ``documents``. Null and empty texts have no words and fail the quality rules; a null language or source is one of its own.
Rows that share an id stay or go together; of ties the least id stays; equal rows count once from the second stage on. Without labels
only the base rule holds, and an empty table gives an empty one. ``run`` writes each stage to the shared folder and reads it again, as a driver of STAGES does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, ngram_join, pii, quality
from quillspark.llm.common import dropped, staged, table
from quillspark.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified threshold rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (32-bit little-endian), their number and digest, and the digest of what they decode to."""
    return bpe.encode_texts(docs, tokenizer_path(), columns=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", personal_data),
    ("source mix", source_mix),
    ("BPE", token_ids),
]

#: Message passing, exact merges and random rounding have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return after
        after = staged(after, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        dropped(docs)
        docs = after
    return docs
