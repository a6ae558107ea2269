"""Benchmark decontamination: a BM25 inverted index of test items, asked for
every training passage with block-max WAND, and a check of the question's and
the answer's words.

The index is built by Spark: term counts, document frequencies and impacts
over all items. An item's impacts are divided by their sum, so a passage's
score is the share of an item's BM25 weight that it holds, whatever the item.
Items of like length (up to 32 words, 64, 128 ...) are dealt to shards of
bounded size; small shards are collected and broadcast together, up to the
size of one, and every document is asked against every shard.

A document's passages are all its half-overlapping windows, wide enough to
hold a span of any item of the shard whole; a long item does not widen the
passages of a short one. The passages of a batch are evaluated together. Terms
with short lists are scored first; WAND's bound (what is scored plus all that
an item's long-list terms could add) drops most pairs of passage and item,
the block maxima of the long lists drop most of the rest, and the others get
their full score. Every pair at or above the threshold is verified: the words
of the item's question and of its answer must stand in order within one span
of the passage, one and a half times as long as the item. An item without an
answer mark also counts where that share of all its words stands there that is
asked of a question: its last sentence need not be an answer.

Defined results: null or empty texts and items lead to no match; items of
fewer than ``SHORT_WORDS`` words must stand in the text word by word; equal
items are reported each; repeated rows are searched each; a null ``doc_id`` or
``item_id`` stays null; an empty table on either side gives an empty result;
only ``doc_id``/``item_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_batches, stored, text_bytes, transposed, word_bounds

K1, B = 1.2, 0.75
#: Share of an item's BM25 weight that a passage must hold.
THRESHOLD = 0.5
#: Shares of the question's and the answer's words that must stand in order.
QUESTION_SHARE, ANSWER_SHARE = 0.8, 0.6
SHORT_WORDS = 8
#: Words of the span, in item lengths, within which an item must stand.
SPAN = 1.5
#: Words of the shortest length class of items.
CLASS_WORDS = 32
#: Items, and bytes of their texts, of one shard of the index on average.
SHARD_ITEMS, SHARD_BYTES = 20_000, 8 << 20
#: Items of one block of a posting list.
BLOCK_ITEMS = 64
#: Lists up to this share of a shard's items (or this many) are short.
SHORT_SHARE, SHORT_LIST = 0.02, 4

#: Words are runs of ASCII letters, digits and non-ASCII bytes.
NOT_WORD = np.ones(256, bool)
NOT_WORD[48:58] = NOT_WORD[97:123] = NOT_WORD[128:] = False
_ANSWER = re.compile(r"\n?\s*\b(?:answer|a)\s*:", re.I)
_SENTENCE = re.compile(r"[.!?]\s+(?=\S)|\n+(?=\S)")


def word_hashes(texts) -> list[np.ndarray]:
    """The lower-cased words of each text of an Arrow column, hashed."""
    raw, off = text_bytes(pc.utf8_lower(texts))
    starts, ends, first = word_bounds(raw, off, NOT_WORD)
    words = hash_words(raw, starts, ends)
    return [words[a:b] for a, b in zip(first[:-1], first[1:])]


def question_words(text: str, n_words) -> tuple[int, bool]:
    """Words of the item that belong to the question, and whether an answer
    mark says so; the rest are the answer: from an answer mark on, else the
    last sentence, else the last quarter."""
    total = n_words(text)
    for mark in (_ANSWER, _SENTENCE):
        marks = list(mark.finditer(text))
        cut = n_words(text[:marks[-1].end()]) if marks else 0
        if 0 < cut < total:
            return cut, mark is _ANSWER
    return total - total // 4, False


def _count_words(text: str) -> int:
    return len(word_hashes(pa.array([text], pa.string()))[0])


def item_table(items: DataFrame) -> DataFrame:
    """(item, item_id, words, n_question, marked, n_bytes) of the items with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for i, text, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_hashes(b.column(1))):
                row += 1
                if len(words):
                    out.append((row, i, words.view(np.int64), *question_words(text, _count_words), len(words) * 8))
            yield transposed(out, 6)

    return stored(map_batches(items.select(F.col("item_id").cast("long"), "text"),
                              "item long, item_id long, words array<long>, n_question int, marked boolean, n_bytes long", run), "items")


def span_words(n: int) -> int:
    """Words of the span of an item of ``n`` words."""
    return int(SPAN * n)


def build_index(items: DataFrame) -> Iterator[Shard]:
    """The shards of the index, one at a time; those of the shortest length
    class come first."""
    t = item_table(items).withColumn("class", F.greatest(F.lit(0), F.ceil(F.log2(F.size("words") / CLASS_WORDS))).cast("int"))
    total = t.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avg")).first()
    if not total["n"]:
        return
    # bounded: one row for each doubling of an item's length
    classes = t.groupBy("class").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"),
                                     F.max(F.size("words")).alias("longest")).orderBy("class").collect()
    first, longest, shard = 0, [], F.lit(None).cast("int")
    for c in classes:
        shards = max(-(-c["n"] // SHARD_ITEMS), -(-c["b"] // SHARD_BYTES))
        shard = F.when(F.col("class") == c["class"], F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int") + first).otherwise(shard)
        first += shards
        longest += [c["longest"]] * shards
    shard = shard.alias("shard")
    terms = t.select("item", shard, F.size("words").alias("n"), F.explode("words").alias("term")).groupBy(
        "item", "shard", "n", "term").agg(F.count("*").alias("tf"))
    terms = stored(terms, "item-terms")
    df = stored(terms.groupBy("term").agg(F.count("*").alias("df")), "item-frequencies")
    idf = F.log(1 + (total["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / total["avg"]))
    postings = terms.join(df, "term").select("shard", "item", "term", impact.alias("impact"))
    postings = stored(postings, "postings")
    t = stored(t.withColumn("shard", shard), "items")
    for s in range(first):
        # bounded: one shard's items and their postings
        rows = t.where(F.col("shard") == s).orderBy("item").toPandas()
        if len(rows):
            yield Shard.of(rows, postings.where(F.col("shard") == s).toPandas(), int(longest[s]))


def shard_groups(shards: Iterator[Shard]) -> Iterator[list[Shard]]:
    """Lists of shards that together are no larger than one may be."""
    group: list[Shard] = []
    for s in shards:
        both = [*group, s]
        if group and (sum(len(x.words) for x in both) > SHARD_ITEMS or sum(w.nbytes for x in both for w in x.words) > SHARD_BYTES):
            yield group
            both = [s]
        group = both
    if group:
        yield group


@dataclass
class Shard:
    """One shard: terms with their posting lists, and the items' words."""

    item_ids: list
    words: list[np.ndarray]
    n_question: list[int]
    marked: list[bool]          # does an answer mark part question and answer?
    stride: int
    terms: np.ndarray           # sorted term hashes
    at: np.ndarray              # first posting of a term
    item: np.ndarray            # postings: item and share of its weight
    impact: np.ndarray
    short: np.ndarray           # is a term's list short?
    long_total: np.ndarray      # of an item: weight of its long-list terms
    long_row: np.ndarray        # of a term: its row in block_max, or -1
    block_max: np.ndarray       # long lists: most impact within each block
    own_terms: list[np.ndarray]
    own_impacts: list[np.ndarray]

    @classmethod
    def of(cls, rows: pd.DataFrame, postings: pd.DataFrame, longest: int) -> Shard:
        n = len(rows)
        place = pd.Series(np.arange(n), index=rows["item"].to_numpy())
        item = place[postings["item"].to_numpy()].to_numpy().astype(np.int32)
        term = postings["term"].to_numpy().astype(np.int64).view(np.uint64)
        impact = postings["impact"].to_numpy(float)
        impact = impact / np.bincount(item, impact, n)[item]
        order = np.lexsort((item, term))
        item, term, impact = item[order], term[order], impact[order]
        terms, at, size = np.unique(term, return_index=True, return_counts=True)
        short = size <= max(SHORT_LIST, int(SHORT_SHARE * n))
        number = np.repeat(np.arange(len(terms)), size)
        long_post = ~short[number]
        long_row = np.where(short, -1, np.cumsum(~short) - 1)
        block_max = np.zeros((int((~short).sum()), n // BLOCK_ITEMS + 1))
        np.maximum.at(block_max, (long_row[number[long_post]], item[long_post] // BLOCK_ITEMS), impact[long_post])
        by_item = np.argsort(item, kind="stable")
        cuts = np.searchsorted(item[by_item], np.arange(n + 1))
        own = [by_item[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        ids = [None if pd.isna(i) else int(i) for i in rows["item_id"]]
        return cls(ids, [np.asarray(w, np.int64).view(np.uint64) for w in rows["words"]], rows["n_question"].tolist(), rows["marked"].tolist(),
                   max(CLASS_WORDS, span_words(longest)), terms, np.append(at, len(item)), item, impact, short,
                   np.bincount(item[long_post], impact[long_post], n), long_row, block_max,
                   [number[o] for o in own], [impact[o] for o in own])

    def retrieve(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(document, window, item, score) of every passage and item whose
        score reaches the threshold."""
        lens = np.array([len(w) for w in docs], np.int64)
        if not lens.sum():
            return []
        words = np.concatenate(docs)
        doc = np.repeat(np.arange(len(docs)), lens)
        inside = np.arange(len(words)) - np.repeat(np.cumsum(lens) - lens, lens)
        n_windows = -(-lens // self.stride)
        base = np.cumsum(n_windows) - n_windows
        number = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[number] == words)
        number, half = number[hit], inside[hit] // self.stride
        window = base[doc[hit]] + half
        # a word stands in the window that begins with its half, and in the one before
        back = half > 0
        window, number = np.concatenate([window, window[back] - 1]), np.concatenate([number, number[back]])
        short = self.short[number]
        pairs = np.unique(window[short] * len(self.terms) + number[short])
        w, t = pairs // len(self.terms), pairs % len(self.terms)
        size = self.at[t + 1] - self.at[t]
        post = np.repeat(self.at[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys, slot = np.unique(np.repeat(w, size) * len(self.item_ids) + self.item[post], return_inverse=True)
        scored = np.bincount(slot, self.impact[post], len(keys))
        # items whose short-list terms alone leave the threshold to long ones
        open_items = np.flatnonzero(self.long_total >= THRESHOLD)
        if len(open_items):
            every = np.unique(window)
            extra = np.setdiff1d((every[:, None] * len(self.item_ids) + open_items).ravel(), keys)
            keys, scored = np.concatenate([keys, extra]), np.concatenate([scored, np.zeros(len(extra))])
        w, i = keys // len(self.item_ids), keys % len(self.item_ids)
        keep = np.flatnonzero(scored + self.long_total[i] >= THRESHOLD - 1e-9)
        order = np.argsort(window, kind="stable")
        ends = np.searchsorted(window[order], np.arange(n_windows.sum() + 1))
        out = []
        for k in keep.tolist():
            here = np.unique(number[order[ends[w[k]]:ends[w[k] + 1]]])
            rows = self.long_row[here]
            if scored[k] + self.block_max[rows[rows >= 0], i[k] // BLOCK_ITEMS].sum() < THRESHOLD - 1e-9:
                continue
            own = self.own_terms[i[k]]
            score = float(self.own_impacts[i[k]][np.isin(own, here, assume_unique=True)].sum())
            if score >= THRESHOLD - 1e-9:
                d = int(np.searchsorted(base, w[k], "right")) - 1
                out.append((d, int(w[k] - base[d]), int(i[k]), score))
        return out

    def matches(self, docs: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float, float, int]]:
        """(document, item) -> best score, question's and answer's share and
        the number of verified passages."""
        found: dict = {}
        for d, window, i, score in self.retrieve(docs):
            item, n = self.words[i], len(docs[d])
            lo = max(0, window * self.stride - len(item))
            near = docs[d][lo:min(n, (window + 2) * self.stride + len(item))]
            q, a = self._shares(item, self.n_question[i], near)
            ok = q >= QUESTION_SHARE and a >= ANSWER_SHARE
            if not ok and not self.marked[i]:
                ok, q, a = self._whole(item, self.n_question[i], near)
            if ok:
                s, q0, a0, k = found.get((d, i), (0.0, 0.0, 0.0, 0))
                found[d, i] = (max(s, score), max(q, q0), max(a, a0), k + 1)
        return found

    @staticmethod
    def _shares(item: np.ndarray, cut: int, near: np.ndarray) -> tuple[float, float]:
        """Shares of the question's and the answer's words in order within
        one span, the one with the most words of those that pass, or zeros."""
        if len(item) < SHORT_WORDS:
            n = len(near) - len(item) + 1
            same = n > 0 and np.logical_and.reduce([near[j:j + n] == x for j, x in enumerate(item)]).any()
            return (1.0, 1.0) if same else (0.0, 0.0)
        at = np.flatnonzero(np.isin(near, item))
        parts = [item[:cut].tolist(), item[cut:].tolist()]
        least = [s * len(p) - 1e-9 for s, p in zip((QUESTION_SHARE, ANSWER_SHARE), parts)]
        hits = near[at].tolist()
        found = best_span(parts, least, hits, np.searchsorted(at, at + span_words(len(item))))
        return tuple(n / len(p) if p else 1.0 for n, p in zip(found, parts)) if found else (0.0, 0.0)


    @staticmethod
    def _whole(item: np.ndarray, cut: int, near: np.ndarray) -> tuple[bool, float, float]:
        """Whether a question's share of all words stands in order within one
        span, and the shares of both parts there."""
        if len(item) < SHORT_WORDS:
            return False, 0.0, 0.0
        at = np.flatnonzero(np.isin(near, item))
        words, hits = item.tolist(), near[at].tolist()
        ends = np.searchsorted(at, at + span_words(len(item)))
        got = best_span([words], [QUESTION_SHARE * len(words) - 1e-9], hits, ends)
        if got is None:
            return False, 0.0, 0.0
        # the first span with the most words
        i = next(i for i, e in enumerate(ends) if e - i >= got[0] and in_order(words, hits[i:e]) == got[0])
        return True, *(in_order(p, hits[i:ends[i]]) / len(p) if p else 1.0 for p in (words[:cut], words[cut:]))


def best_span(parts: list[list[int]], least: list[float], text: list[int], ends: np.ndarray) -> tuple[int, int] | None:
    """Words of each of ``parts`` that stand in order in one of the spans
    ``text[i:ends[i]]``: of the span with the most among those that reach
    ``least``. Spans that cannot do better than the ones seen are left out: a
    word that enters a span adds one word to each part at most."""
    if any(in_order(p, text) < n for p, n in zip(parts, least)):
        return None
    best, most = None, -1
    i, everything = 0, sum(map(len, parts))
    while i < len(text) and most < everything:
        got = tuple(in_order(p, text[i:ends[i]]) for p in parts)
        if all(g >= n for g, n in zip(got, least)) and sum(got) > most:
            best, most = got, sum(got)
        lacks = max(1, *(math.ceil(n - g) for g, n in zip(got, least)), -(-(most + 1 - sum(got)) // 2))
        i = max(i + 1, int(np.searchsorted(ends, ends[i] + lacks)))
    return best


def in_order(words: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each word."""
    masks: dict[int, int] = {}
    for i, x in enumerate(words):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(words)) - 1
    s = full
    for x in text:
        u = s & masks.get(x, 0)
        s = ((s + u) | (s - u)) & full
    return len(words) - s.bit_count()


MATCHES = "doc_id long, item_id long, score double, question_share double, answer_share double, n_passages int"


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and test item found in it."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], MATCHES)
    for shards in shard_groups(build_index(items)):
        shared = spark.sparkContext.broadcast(shards)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[list]:
            for b in batches:
                ids, docs = b.column(0).to_pylist(), word_hashes(b.column(1))
                yield transposed([(ids[d], shard.item_ids[i], *v) for shard in shared.value
                                  for (d, i), v in shard.matches(docs).items()], 6)

        out = out.unionByName(map_batches(text, MATCHES, run))
    return out


def _leaks(shared: Broadcast):
    """A pandas UDF from texts to whether they hold an item of the shards."""
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        docs = word_hashes(pa.array(texts, pa.string(), from_pandas=True))
        bad = np.zeros(len(texts), bool)
        for shard in shared.value:
            bad[[d for d, _ in shard.matches(docs)]] = True
        return pd.Series(bad)

    return leaks


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item; no shuffle."""
    for shards in shard_groups(build_index(items)):
        docs = docs.where(~_leaks(docs.sparkSession.sparkContext.broadcast(shards))(F.col("text")))
    return docs
