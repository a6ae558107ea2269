"""Corpus pipeline: quality rules, toxicity, near duplicates, benchmark
decontamination and packing, each over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``. Null and empty texts have no words, so
the quality rules drop them; an empty table stays empty; extra columns of
``docs``, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm import op03_best_fit, op05_decontamination, op06_quality_rules, op07_token_groups, op09_toxicity
from srcatlas.llm.common import bounded_batches, stored, table
from srcatlas.llm.tokens import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rule or the learned rules reject."""
    rules = op06_quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return op06_quality_rules.keep_good(docs, rules)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity score is 0.5 or more."""
    model = op09_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    bounded_batches(spark)
    return docs.where(op09_toxicity.scorer(model)(F.col("text")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest doc_id) of each group of linked ones."""
    return op07_token_groups.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    bounded_batches(spark)
    return op05_decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens."""
    return op03_best_fit.packed_documents(docs, vocabulary_path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality_rules", quality), ("toxicity", toxicity), ("ngram_jaccard_join", near_duplicates),
          ("benchmark_decontamination", decontamination), ("best_fit_packing", packing)]

#: No SQL states the learned rules, scores and packing; tests/llm compares
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
