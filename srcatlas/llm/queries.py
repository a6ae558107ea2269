"""The registered queries of this subpackage: one for each operator, over the
whole table it is meant for, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import vocabulary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_separator_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of all documents: two-byte ids with the free id 50256 of
    the multilingual byte vocabulary as end of document."""
    from .op01_separator_scan import documents_counted
    return documents_counted(spark, table(spark, sf, "documents"), vocabulary_path("byte_bpe_multi_50k.tiktoken"), 50256)


@_query
def op3_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    from .op03_best_fit import packed_documents
    return packed_documents(table(spark, sf, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1)


@_query
def op8_frames(spark: SparkSession, sf: str) -> DataFrame:
    from .op08_frames import documents_as_frames
    return documents_as_frames(spark, table(spark, sf, "documents"), vocabulary_path("byte_bpe_50k.json"), end_id=0)


@_query
def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .op10_license_scan import scan_licenses
    return scan_licenses(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


@_query
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from .op06_quality_rules import report
    return report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@_query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from .op09_toxicity import fit, score_documents
    docs = table(spark, sf, "documents")
    return score_documents(docs, fit(docs, table(spark, sf, "labels")))


@_query
def op7_token_groups(spark: SparkSession, sf: str) -> DataFrame:
    from .op07_token_groups import linked_documents
    return linked_documents(table(spark, sf, "documents"))


@_query
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from .op05_decontamination import contaminated_pairs
    return contaminated_pairs(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@_query
def op4_main_text(spark: SparkSession, sf: str) -> DataFrame:
    from .op04_main_text import fit_pages, main_texts
    pages = table(spark, sf, "pages")
    return main_texts(pages, fit_pages(pages))


@_query
def op2_ctw_scoring(spark: SparkSession, sf: str) -> DataFrame:
    from .op02_ctw_scoring import score_documents
    return score_documents(table(spark, sf, "documents"))


@_query
def op11_dual_tree(spark: SparkSession, sf: str) -> DataFrame:
    from .op11_dual_tree import ranked
    return ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@_query
def op12_nn_descent(spark: SparkSession, sf: str) -> DataFrame:
    from .op12_nn_descent import linked
    return linked(table(spark, sf, "embeddings"))


@_query
def op13_radix_trie(spark: SparkSession, sf: str) -> DataFrame:
    from .op13_radix_trie import trie_nodes
    return trie_nodes(table(spark, sf, "conversations"))


@_query
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


def _oracles() -> dict[str, str]:
    from . import op11_dual_tree as op11
    from . import op12_nn_descent as op12
    from . import op13_radix_trie as op13
    return {"op11_dual_tree": op11.SQL, "op12_nn_descent": op12.SQL, "op13_radix_trie": op13.SQL}


ORACLES.update(_oracles())
