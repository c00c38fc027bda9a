"""From raw documents to token files: toxicity, near duplicates, benchmark passages, mix, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm.common import written
from cuelight.llm.decontamination import decontaminate
from cuelight.llm.mixing import mixed_documents
from cuelight.llm.ngram_join import one_of_each
from cuelight.llm.token_files import token_files
from cuelight.llm.toxicity import drop_toxic

VOCABULARY, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2
#: Near duplicates: runs of five words, Jaccard similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't find toxic, with all columns as they are.

    Null and empty texts have no words to be toxic by; rows of one doc_id, and rows without one, are judged by their own
    text, so that repeated rows go or stay together. An empty table stays so.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Rows without words or without a doc_id stay; unrelated rows of one doc_id stay; of equal rows one stays.
    """
    return one_of_each(docs, SHINGLE, PERCENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; n_chars is the length of the text that is left.

    Rows without passages, null and empty texts among them, and repeated rows stay as they are; a document that is
    mostly passages goes.
    """
    clean = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the files' order that of the schedule.

    Null sources are a source; null doc_ids are ids like others; rows without words are never taken.
    """
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in ascending doc_id order, null ids first, read back per document.

    Repeated rows are documents of their own; a null or empty text is one end id; an empty table gives no files.
    """
    return token_files(docs, VOCABULARY, END_ID)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("mix", mix), ("token_ids", token_ids)]

#: Models, hash order and a tokenizer: SQL can't express them. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the others return is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
