"""The queries of this package, by the tables they read."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    exact_dedup,
    html_text,
    mixing,
    passages,
    periods,
    pii,
    quality,
    secrets,
    simhash,
    token_counts,
    weighted_sampling,
    whitening,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry quality score of every document."""
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns, and spans of high entropy."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[secrets.counted(spans, k.name).alias(f"n_{k.name}") for k in secrets.KINDS],
        F.sha2(secrets.listed(secrets.fixed_spans(spans)).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the bytes they decode to, as digests."""
    docs = _table(spark, sf_dir, "documents")
    decoded = bpe.decode(bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(tokens) div 4").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    plan = mixing.mixing_plan(_table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    printed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", printed, "component_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every document, its edited text and its neighbour."""
    found = weighted_sampling.fingerprints(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    counts = token_counts.prefix_counts(_table(spark, sf_dir, "documents"), WORD_BPE)
    n = token_counts.total(F.col("counts"))
    return counts.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of which are made to repeat."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.periodic_runs(periods.with_planted_runs(docs))
    best = periods.strongest(F.col("runs"))
    marked = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(periods.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return marked.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: plain, and behind disguises."""
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[pii.counted(spans, k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(pii.plain_spans(spans)).cast("binary"), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened by their first components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_secret_scan,
        op3_repeated_passages,
        op4_byte_bpe,
        op5_exact_dedup,
        op6_mixing,
        op7_simhash,
        op8_html_text,
        op9_weighted_sampling,
        op10_token_counts,
        op11_periodic_runs,
        op12_personal_data,
        op13_embedding_whitening,
    )
}
