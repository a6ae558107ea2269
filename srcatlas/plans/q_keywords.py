"""Queries: keywords (O77, O100, O120-O123) over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import keywords as kw
from ..sources import fixtures as fx
from . import duck as D
from .q_text import preprocess_sql
from .registry import query

R = D.q
TOKEN = r"[\p{L}\p{N}_]{2,}"


def _stop() -> str:
    return D.lst(K.default_stop_words())


def counts_ctes(src: str = "documents", key: str = "doc_id", text: str = "text") -> list[tuple[str, str]]:
    return [
        ("toks", f"SELECT {key} AS doc_id, list_filter(regexp_extract_all(lower({text}), {R(TOKEN)}), lambda t: NOT list_contains({_stop()}, t)) AS t FROM {src}"),
        ("grams", "SELECT doc_id, unnest(t) AS term FROM toks UNION ALL "
                  "SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM toks WHERE len(t) > 1"),
        ("cnt", "SELECT doc_id, term, count(*) AS n FROM grams GROUP BY 1, 2"),
        ("scored", "SELECT doc_id, term, n, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS score FROM cnt"),
    ]


def top_sql(src: str, where: str = "TRUE", n: int = K.KEYWORDS_TOP_N) -> str:
    return f"""SELECT doc_id, term, round(score, 6) AS score, rank FROM (
  SELECT doc_id, term, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS INTEGER) AS rank
  FROM {src} WHERE {where}) WHERE rank <= {n}"""


def _out(df):
    return df.select("doc_id", "term", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("keywords_tfidf", lambda: D.with_ctes([], counts_ctes()) + top_sql("scored", "NOT contains(term, ' ') AND length(term) > 2"))
def keywords_tfidf(spark, sf):
    """Top 10 terms per document, each document fitted on its own."""
    return _out(kw.keywords(fx.table(spark, sf, "documents")))


@query("keywords_candidates", lambda: D.with_ctes([], counts_ctes() + [
    ("cand", f"""SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(list_filter(
  regexp_extract_all(lower({preprocess_sql('text')}), {R(TOKEN)}), lambda t: length(t) >= 3 AND NOT list_contains({_stop()}, t))) AS term FROM documents)"""),
    ("kept", "SELECT s.* FROM scored s SEMI JOIN cand c ON c.doc_id = s.doc_id AND c.term = s.term"),
]) + top_sql("kept"))
def keywords_candidates(spark, sf):
    """Features intersected with the candidate terms by a join."""
    docs = fx.table(spark, sf, "documents")
    return _out(kw.keywords(docs, candidates=kw.candidate_terms(docs, per_id=True)))


@query("keywords_corpus", lambda: D.with_ctes([], counts_ctes() + [
    ("idf", "SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM cnt GROUP BY term"),
    ("w", "SELECT c.doc_id, c.term, c.n * i.idf AS w FROM cnt c JOIN idf i ON i.term = c.term"),
    ("cs", "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS score FROM w"),
]) + top_sql("cs"))
def keywords_corpus(spark, sf):
    return _out(kw.keywords_corpus(fx.table(spark, sf, "documents")))


@query("keywords_memo", lambda: D.with_ctes([], counts_ctes() + [
    ("memo", f"""SELECT d.doc_id, k.term, k.score, k.rank FROM documents d JOIN (
  {top_sql('scored', "NOT contains(term, ' ') AND length(term) > 2")}) k ON k.doc_id = d.doc_id"""),
]) + "SELECT doc_id, term, score, rank FROM memo")
def keywords_memo(spark, sf):
    """Keywords computed once per distinct text and shared by its copies."""
    docs = fx.table(spark, sf, "documents")
    return _out(kw.memoize_by_text(docs, lambda d: kw.keywords(d)))
