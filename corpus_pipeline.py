"""Training-data pipeline over ``documents``: filter, deduplicate, decontaminate, tokenize.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet to the
shared folder and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``.  Rows with null ids and null or empty texts pass the stages that can't judge
them; each stage's operator states its cases.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm import bpe, decontaminate, ngram_jaccard, quality_fm, suffix_dedup
from pagefold.llm.common import read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more (operator 4)."""
    return quality_fm.accepted(docs, quality_fm.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over five words: the one of the
    smallest id (operator 5)."""
    others = ngram_jaccard.components(docs, words=5, percent=80).filter("doc_id != component_id").select("doc_id")
    return docs.join(stage(others, "pipeline-copies"), "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that documents of smaller ids hold too (operator 2)."""
    return suffix_dedup.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found (operator 7)."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and the digests of the ids and of the bytes decoded from them (operator 1)."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digested(bpe.encode_and_decode(docs, path, pattern), keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("benchmark", benchmark), ("tokens", tokens)]

#: SQL expresses neither the trained stage nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
