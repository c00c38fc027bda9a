"""The registered queries of the document operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    from cuelight.llm.quality_classifier import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    from cuelight.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document."""
    from cuelight.llm.language_id import language_report

    return language_report(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each document."""
    from cuelight.llm.decontamination import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document in strings of 100 bytes that also start earlier."""
    from cuelight.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts that a mix to target weights takes of each document."""
    from cuelight.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    from cuelight.llm.toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict per document."""
    from cuelight.llm.quality_rules import quality_rules

    out = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back per document."""
    import public_tokenizers

    from cuelight.llm.token_files import token_files

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op10_shard_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as found in a compacted store of shards."""
    from cuelight.llm.shard_store import shard_report, sharded

    return shard_report(sharded(_table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {f.__name__: f for f in (op1_quality_classifier, op2_ngram_join, op3_language_id, op4_decontamination, op5_suffix_dedup, op6_mix_sources, op7_toxicity, op8_quality_rules, op9_token_files, op10_shard_store, pipeline)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    from cuelight.llm import decontamination, mixing, quality_rules

    return {"op4_decontamination": decontamination.ORACLE, "op6_mix_sources": mixing.ORACLE, "op8_quality_rules": quality_rules.ORACLE}
