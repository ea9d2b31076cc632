"""From raw documents to token ids: each stage is written as Parquet and read again by the next.

  language_id      documents whose language isn't known, or with a score under the model's floor (set on labelled
                   documents that the fit didn't use), go
  line_dedup       lines found in 10 or more documents go from the texts of all of them
  minhash          of near-duplicate documents the one with the smallest doc_id stays
  decontamination  documents that hold ten consecutive words of a benchmark item go
  bpe              texts become token ids, given with their digests

All stages but the last keep the columns of documents. There is no SQL for the first stage, so none for the whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import bpe_automaton, common, decontamination, language_id, line_dedup, minhash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, common.documents(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(bpe_automaton.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
