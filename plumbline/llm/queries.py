"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import table
from plumbline.llm.filter_audit import ORACLE as AUDIT_ORACLE
from plumbline.llm.line_dedup import ORACLE as LINE_ORACLE
from plumbline.llm.resampling import ORACLE as RESAMPLING_ORACLE
from plumbline.llm.sharding import oracle as sharding_oracle

#: production parameters of the placement table: a prime number of slots, over a hundred for each shard
SHARDS, SLOTS = 32, 4093


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.sharding import assign, shard_names

    return assign(table(spark, sf_dir, "documents"), shard_names(SHARDS), SLOTS)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.piece_encoding import encoding_digest

    return encoding_digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 4096)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=5, scale=256.0, every=50)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.repeats import removal_digest

    return removal_digest(table(spark, sf_dir, "documents"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.line_dedup import line_digest

    return line_digest(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_minhash_near_dedup, op3_sharding, op4_quality_classifier, op5_piece_encoding, op6_best_fit_packing, op7_exact_top_k, op8_token_counts, op9_toxicity, op10_suffix_array_dedup, op11_filter_interaction_audit, op12_line_dedup, op13_importance_resampling)}
ORACLE_SQL: dict[str, str] = {
    "op3_sharding": sharding_oracle(SHARDS, SLOTS),
    "op11_filter_interaction_audit": AUDIT_ORACLE,
    "op12_line_dedup": LINE_ORACLE,
    "op13_importance_resampling": RESAMPLING_ORACLE,
}
