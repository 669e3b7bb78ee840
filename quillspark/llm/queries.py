"""One query for each operator, over whole tables with production parameters: (spark, sf_dir) → DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ball_kmeans, filter_audit, ngram_join, quality
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op6_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transcripts import parse_transcripts

    return parse_transcripts(table(spark, sf_dir, "conversations"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), tokenizer_path(), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .paragraph_dedup import find_repeats

    return find_repeats(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import joined

    return joined(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    kept = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media", "fingerprints")
    return media_columns(table(spark, sf_dir, "documents"), columns=kept)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_license_scan, op3_url_filter, op4_quality_rules, op5_pii_spans, op6_transcript_roles, op7_bpe_codec, op8_paragraph_dedup, op9_ngram_join, op10_media_columns, op11_filter_audit, op12_ball_kmeans, op13_html_text)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op9_ngram_join": ngram_join.ORACLE, "op4_quality_rules": quality.oracle(), "op11_filter_audit": filter_audit.ORACLE, "op12_ball_kmeans": ball_kmeans.oracle()}
