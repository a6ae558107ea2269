"""Keyword extraction: TF-IDF over unigrams and bigrams.

* ``keywords``: each text on its own (one-document fit: idf is 1, so a
  term's score is its count over the L2 norm of the text's counts), kept
  to candidate terms, top ``n`` per text.
* ``keywords_corpus``: smooth idf over the whole corpus,
  ``ln((1 + N) / (1 + df)) + 1``.
* ``memoize_by_text``: run an operator once per distinct text and join the
  result back to every copy.

Tokens are runs of two or more word characters, lower-cased; stop words
are removed before bigrams are formed. Tokenising uses Spark ML feature
transformers (JVM). A text that alone has its id is counted, scored and ranked
within its row, so no exploded term is sorted or moved; the terms of ids that
several rows share are merged by group-bys. The top-``n`` ranking uses a
constant limit. ``keywords_corpus`` counts and ranks a part of the corpus at a
time in Python (``corpus_terms``), over the words of the same tokeniser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from . import corpus_terms as ct
from .chunking import _let

#: Parts that the corpus and its terms are dealt to, at least; parts that a
#: text's copies are dealt to in joins.
TERM_PARTS, SALTS = 256, 8
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def _tokenize(df: DataFrame, text: Column, stop_words: list[str], min_len: int = 2, out: str = "_t") -> DataFrame:
    """Adds ``out``: lower-cased word runs of ``min_len``+ chars without stop
    words, in order. Spark ML transformers (JVM, hash-set stop lookup)."""
    from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
    src = df.withColumn("_text", text)
    tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=TOKEN_RE, gaps=False,
                         toLowercase=True, minTokenLength=min_len)
    swr = StopWordsRemover(inputCol="_tok", outputCol=out, stopWords=list(stop_words), caseSensitive=True)
    return swr.transform(tok.transform(src)).drop("_text", "_tok")


def _terms(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """Adds ``_terms``: unigrams and bigrams of ``text`` (bigrams are formed
    after stop-word removal)."""
    from pyspark.ml.feature import NGram
    t = _tokenize(docs, F.col("text"), stop_words)
    g = NGram(n=2, inputCol="_t", outputCol="_bg").transform(t)
    return g.withColumn("_terms", F.concat("_t", "_bg")).drop("_t", "_bg")


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                stop_words: list[str] | None = None) -> DataFrame:
    """(id, term, n): unigram and bigram counts per text (bigrams are formed
    after stop-word removal).

    Rows are first dealt out by id: one shuffle of the texts then serves the
    counts and every later grouping or window by id, and no exploded term
    moves."""
    sw = K.default_stop_words() if stop_words is None else stop_words
    docs = docs.repartition(id_col)
    t = _terms(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), sw)
    return _grouped_counts(t)


def _grouped_counts(t: DataFrame) -> DataFrame:
    ex = t.select("doc_id", F.explode("_terms").alias("term"))
    return ex.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def counted(terms: Column) -> Column:
    """The distinct terms of an array as (n, term), within the row: equal
    terms stand together once sorted, and a run's length is its count."""
    def runs(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i + 1).eqNullSafe(F.get(s, i)))
        return _let(ends, lambda e: F.transform(e, lambda i, k: F.struct(
            (i - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("bigint").alias("n"), F.get(s, i).alias("term"))))

    return _let(F.sort_array(terms), runs)


def _with_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, _copies): with the number of rows that share the id.
    Dealt out by id over a stated number of tasks: else Spark merges tasks by
    bytes, and these have more to do than bytes to read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return rows.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))


def _by_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that alone have their id, and the others."""
    return rows.where("_copies = 1").drop("_copies"), rows.where("_copies > 1").drop("_copies")


def candidate_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    stop_words: list[str] | None = None, min_len: int = 3, per_id: bool = False) -> DataFrame:
    """(id, term): distinct words of each text's preprocessed form, longer
    than two characters and not stop words (the part-of-speech rule is not
    built). Words are de-duplicated inside each row, so with one row per id
    the pairs are distinct without a shuffle (and a semi join against them
    does not care about repeats).

    With ``per_id`` (id, terms): one row per id with its words, for
    ``keywords`` to join by id alone."""
    sw = K.default_stop_words() if stop_words is None else stop_words

    def words(rows: DataFrame) -> DataFrame:
        t = _tokenize(rows, tx.preprocess(F.col("text")), sw, min_len=min_len)
        return t.select("doc_id", F.array_distinct("_t").alias("terms"))

    if not per_id:
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return words(rows).select("doc_id", F.explode("terms").alias("term"))
    once, again = _by_copies(_with_copies(docs, id_col, text_col))
    return words(once).unionByName(_per_id(words(again).select("doc_id", F.explode("terms").alias("term"))))


def _per_id(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc_id").agg(F.collect_set("term").alias("terms"))


def _top(scored: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.asc("term"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _ranked(rows: DataFrame, top_n: int, keep: Callable[[Column], Column] | None = None,
            pick: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, term, score, rank) of rows that alone have their id, within
    the row: ``keep`` filters the counts, ``pick`` takes what it wants from
    the array of (_less, term) in rank order, ``_less`` being minus the count."""
    def best(f: Column) -> Column:
        norm = F.sqrt(F.aggregate(f, F.lit(0).cast("bigint"), lambda s, x: s + x["n"] * x["n"]))
        kept = keep(f) if keep else f
        order = F.sort_array(F.transform(kept, lambda x: F.struct((-x["n"]).alias("_less"), x["term"].alias("term"))))
        return F.struct(norm.alias("norm"), F.slice(_let(order, pick) if pick else order, 1, top_n).alias("top"))

    b = rows.select("doc_id", F.explode(F.array(_let(counted(F.col("_terms")), best))).alias("_b"))
    t = b.select("doc_id", "_b.norm", F.posexplode("_b.top").alias("_i", "_x"))
    return t.select("doc_id", F.col("_x.term").alias("term"), (-F.col("_x._less") / F.col("norm")).alias("score"),
                    (F.col("_i") + 1).alias("rank"))


def keywords(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top_n: int = K.KEYWORDS_TOP_N,
             stop_words: list[str] | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, score, rank): top terms of each text fitted on its own.

    Without ``candidates`` the candidate rule (single word, length > 2, not
    a stop word) is applied in place; with a candidate frame, ``(doc_id,
    term)`` or ``(doc_id, terms)`` with one row per id, the features are
    intersected with it by a join on the id: texts and candidate words meet
    there, and the features are counted after it."""
    sw = K.default_stop_words() if stop_words is None else stop_words
    rows = _with_copies(docs, id_col, text_col)
    if candidates is None:
        def rule(term: Column) -> Column:
            return (~term.contains(" ")) & (F.length(term) > 2)
        once, again = _by_copies(rows)
        alone = _ranked(_terms(once, sw), top_n, keep=lambda f: F.filter(f, lambda x: rule(x["term"])))
        counts = _grouped_counts(_terms(again, sw)).withColumn("_met", rule(F.col("term")))
    else:
        sets = candidates if "terms" in candidates.columns else _per_id(candidates.select("doc_id", "term"))
        once, again = _by_copies(rows.join(sets.select("doc_id", "terms"), "doc_id"))

        def among(order: Column) -> Column:
            # array_intersect leaves the first array's order; only the top is looked up again
            def first(names: Column) -> Column:
                met = F.slice(F.array_intersect(names, F.col("terms")), 1, top_n)
                return F.transform(met, lambda t: F.get(order, (F.array_position(names, t) - 1).cast("int")))
            return _let(F.transform(order, lambda x: x["term"]), first)

        def words(f: Column) -> Column:
            # bigrams need not be ranked where no candidate has a space
            spaced = F.exists("terms", lambda t: t.contains(" "))
            return F.when(spaced, f).otherwise(F.filter(f, lambda x: ~x["term"].contains(" ")))

        def marked(terms: Column | str, met: bool) -> Column:
            return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(met).alias("met")))
        alone = _ranked(_terms(once, sw), top_n, words, among)
        both = F.concat(marked("_terms", False), marked(F.array_intersect("_terms", "terms"), True))
        counts = _terms(again, sw).select("doc_id", F.explode(both).alias("_x")).groupBy("doc_id", F.col("_x.term").alias("term")).agg(
            F.count_if(~F.col("_x.met")).alias("n"), F.max("_x.met").alias("_met"))
    # Of ids that several rows share: L2 norm over all of an id's terms by a
    # window, then the wanted ones.
    w = Window.partitionBy("doc_id")
    scored = counts.withColumn("score", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(w))).where("_met")
    return alone.unionByName(_top(scored, top_n).select("doc_id", "term", "score", "rank"))


def keywords_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top_n: int = K.KEYWORDS_TOP_N,
                    stop_words: list[str] | None = None) -> DataFrame:
    """(doc_id, term, score, rank) with smooth corpus idf and L2 norm.

    Texts are dealt to parts by id, once, as their words without stop words.
    A part's distinct terms go out to be counted in packed blocks, and the
    document frequencies come back in their order (``corpus_terms``); terms are
    scored and ranked in their part. No term is a row, so none is sorted,
    shuffled or spilled as one. ``TERM_PARTS`` bounds what a task holds: a part's
    words, or one of as many buckets of terms."""
    sw = K.default_stop_words() if stop_words is None else stop_words
    # The document count is a scalar subquery: computed once, inlined as a
    # value, no join.
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    parts = max(TERM_PARTS, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = _tokenize(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), sw)
    rows = t.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("_part"), "doc_id",
                    F.array_join("_t", " ").alias("words")).repartition(parts, "_part").groupBy("_part")
    blocks = rows.applyInArrow(ct.blocks_of(parts), ct.BLOCKS).repartition(parts, "_bucket")
    known = blocks.groupBy("_bucket").applyInArrow(ct.frequencies, ct.FREQUENCIES).withColumn("_docs", n_docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.cogroup(known.repartition(parts, "_part").groupBy("_part")).applyInArrow(
        ct.best_of(parts, top_n), f"doc_id {id_type}, term string, score double, rank int")


def memoize_by_text(docs: DataFrame, fn: Callable[[DataFrame], DataFrame], id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Run ``fn`` (keyed by ``doc_id``) once per distinct text, then give
    every copy the result. Copies collapse map-side before the shuffle."""
    h = F.md5(F.col(text_col))
    ids = docs.select(F.col(id_col).alias("doc_id"), h.alias("text_hash"))
    # a text may be a third of all rows: its copies are dealt to SALTS parts by id
    dealt = ids.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    # the smallest id stands for its copies: only ids and numbers of parts are
    # aggregated, and the text comes from the one row that is kept
    seen = dealt.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.collect_set("_part").alias("_parts"))
    uniq = docs.select(F.col(id_col).alias("doc_id"), h.alias("text_hash"), F.col(text_col).alias("text")).join(
        seen.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    res = fn(uniq.select(F.col("text_hash").alias("doc_id"), "text")).withColumnRenamed("doc_id", "text_hash")
    # a result goes to the parts that hold a copy, one for most texts
    held = res.join(seen.select("text_hash", F.explode("_parts").alias("_part")), "text_hash")
    return dealt.join(held, ["text_hash", "_part"]).drop("text_hash", "_part")
