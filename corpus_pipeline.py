"""A training corpus from ``documents``: toxic and poor documents go, one of each group of near copies stays, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
Models are fitted on bounded samples of the labelled rows among ``docs``.

Null, empty and very long texts and repeated rows are scored like others and
packed if they stay; null ids are never near copies; without labels the
toxicity stage keeps every document and the quality stage scores them all 0.5,
which stay too; extra columns are kept until the packing; an empty table gives
no rows. Ties of near copies go to the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import packing, quality, shingle_join, toxicity
from strandloom.llm.common import table
from strandloom.llm.queries import tokenizer_file
from strandloom.scratch import Scratch


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, threshold=0.3)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, threshold=0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs, words=5, num=8, den=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 2)


STAGES = [("toxicity", not_toxic), ("quality", good), ("near_copies", one_of_each), ("packing", packed)]

#: Trained classifiers and tokenizers aren't SQL; tests/llm/test_pipeline.py holds run() and each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = s.saved(stage(spark, docs, sf_dir), name, stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
