"""The registered queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_bpe, op2_quality, op3_chat, op4_minhash, op5_vectors, op6_urls, op7_mixing, op9_secrets, op10_lm, op11_audit, op12_shards, op13_variants
from . import op8_toxicity as toxicity
from .oracle import oracle_sql  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_bpe.digest_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op2_quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_minhash.near_duplicates(_table(spark, sf_dir, "documents"), 80, shingle=2)


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_vectors.near_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_urls.url_verdicts(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op7_mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op9_secrets.secret_spans(_table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, op9_secrets.KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(text(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op12_shards.histogram_shards(_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_variants.spelling_variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_bpe_encode, op2_quality_rules, op3_chat_perspectives, op4_minhash_dedup, op5_vector_dedup, op6_url_filter, op7_source_mix, op8_toxicity_kn, op9_secret_scan, op10_lm_scores,
             op11_filter_audit, op12_histogram_shards, op13_spelling_variants)
    return {f.__name__: f for f in every}
