"""Ranked lexical search by a dual tree.

Every item (a query, a set of terms) gets its ``k`` best documents by an
integer score that adds one coordinate for each of the item's terms:
``w * ((1000000000 * tf) div (1000 * tf + 8 * m))`` with the term's weight
``w`` and the document's length factor ``m``.

Two hierarchies are searched together. A node of the document tree holds, for
each term, the greatest coordinate of its documents; a node of the item tree
holds the union of its items' terms (the coordinate maxima of 0/1 vectors).
The sum of the one over the other bounds every score between the two nodes,
and where it is below the weakest k-th score of the node's items, all of the
node's documents are out for all of the node's items at once. Nothing else is
left out, so the result is exact; a document whose score equals a k-th score
is looked at, because a smaller ``doc_id`` wins.

Steps on Spark:

1. Items are dealt into shards of about ``SHARD_TERMS`` terms; one shard at a
   time is broadcast (8 bytes a term). One pass over the texts turns each
   Arrow batch of documents into a block: ids, lengths and the counts of the
   shard's terms. Document frequencies are added up in parts on the executors.
2. A thirty-second of the blocks is searched first; the k-th scores found are
   lower bounds with which all blocks are searched. A task builds the tree of
   one block at a time, keeps the k best documents of each item over all its
   blocks, and sends only those.
3. A window over (item, score, doc_id) with a group limit takes the k best.

Defined results: a null or empty text, and one without a term, is no document
(N, L) and is never ranked; rows of ``docs`` that share a ``doc_id`` are
documents of their own; a null ``doc_id`` counts and ranks like others, after
all ids of the same score; rows of ``items`` that share an ``item_id`` (null
is an id as well) are one item with all their terms; an item without terms,
and an empty table on either side, gives no rows; other columns are not read.
Terms are compared by a 64-bit hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, map_batches, pack, stored, text_bytes, transposed, unpack, word_bounds

#: Best documents of each item.
TOP = 10
#: Terms of one shard of items on average: what is broadcast at a time.
SHARD_TERMS = 1 << 20
#: Documents of a leaf, and children of an inner node, of either tree.
LEAF = 32
FAN = 8
#: One block of so many is searched first, for the k-th scores.
SEED_SHARE = 32

#: Bytes that end a term: all of ASCII but digits and letters.
NOT_TERM = np.zeros(256, bool)
NOT_TERM[:128] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    NOT_TERM[_lo:_hi] = False


def term_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts of a column, and each text's first."""
    raw, off = text_bytes(col)
    starts, ends, first = word_bounds(raw, off, NOT_TERM)
    return hash_words(raw, starts, ends), first


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct term hashes of each item, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            h, first = term_hashes(b.column(1))
            yield [b.column(0), [np.unique(h[x:y]).view(np.int64) for x, y in zip(first[:-1], first[1:])]]

    rows = map_batches(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id long, terms array<long>", run)
    return rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(
        F.sort_array(F.collect_set("term")).alias("terms"))


# --- the item tree ----------------------------------------------------------

class ItemTree:
    """Items as leaves, in an order that puts items of the same heaviest term
    together; ``FAN`` neighbours make the next node up."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        heavy = [int(t[np.argmax(weights[t])]) for t in terms]
        self.order = sorted(range(len(terms)), key=lambda i: (heavy[i], i))
        sets = [terms[i] for i in self.order]
        self.children: list[list[int]] = [[] for _ in sets]
        self.span = [(i, i + 1) for i in range(len(sets))]
        level = list(range(len(sets)))
        while len(level) > 1:
            up = []
            for i in range(0, len(level), FAN):
                kids = level[i:i + FAN]
                up.append(len(sets))
                sets.append(np.unique(np.concatenate([sets[c] for c in kids])))
                self.children.append(kids)
                self.span.append((self.span[kids[0]][0], self.span[kids[-1]][1]))
            level = up
        self.root = level[0]
        self.n_items = len(terms)
        self.ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        self.flat = np.concatenate(sets)
        self.inner = np.array([bool(c) for c in self.children])

    def terms(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the nodes, one after the other, and where each begins."""
        n = self.ptr[nodes + 1] - self.ptr[nodes]
        begin = np.cumsum(n) - n
        return self.flat[np.arange(n.sum()) + np.repeat(self.ptr[nodes] - begin, n)], begin

    def weakest(self, least: np.ndarray) -> np.ndarray:
        """Of each node, the least of its items' scores to reach."""
        out = np.empty(len(self.children), np.int64)
        out[:self.n_items] = least[self.order]
        for i in range(self.n_items, len(self.children)):
            out[i] = out[self.children[i]].min()
        return out

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of inner nodes, and leaves as they are."""
        return np.array([c for i in nodes for c in (self.children[i] or (i,))], np.int64)


# --- the document tree of a block -------------------------------------------

class DocTree:
    """Coordinate maxima over leaves of ``LEAF`` documents, then of ``FAN``
    nodes each, up to one root. ``rows`` numbers a document for each entry."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, coords: np.ndarray, n_docs: int, n_terms: int):
        self.width = np.int64(n_terms)
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        docs = rows[first]
        # documents with the same strongest term stand together
        best = np.maximum.reduceat(coords, first)
        at_best = coords == np.repeat(best, np.diff(np.r_[first, len(rows)]))
        strongest = np.full(n_docs, n_terms, np.int64)
        strongest[rows[at_best][::-1]] = terms[at_best][::-1]
        strength = np.zeros(n_docs, np.int64)
        strength[docs] = best
        self.docs = docs[np.lexsort((-strength[docs], strongest[docs]))]
        place = np.empty(n_docs, np.int64)
        place[self.docs] = np.arange(len(self.docs))
        at = place[rows]
        by = np.argsort(at * self.width + terms, kind="stable")
        self.at, self.terms, self.coords = at[by], terms[by], coords[by]
        self.levels = []
        node, t, c = self.at // LEAF, self.terms, self.coords
        while True:
            key = node * self.width + t
            by = np.argsort(key, kind="stable")
            key, c = key[by], c[by]
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, c = key[cut], np.maximum.reduceat(c, cut)
            node, t = key // self.width, key % self.width
            n = int(node[-1]) + 1
            self.levels.append((np.searchsorted(node, np.arange(n + 1)), t, c))
            if n == 1:
                break
            node = node // FAN
        self.begins = np.searchsorted(self.at, np.arange(len(self.docs) + 1))


class Best:
    """The k best documents of each item so far, and the score to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = np.maximum(least, 1), k
        self.heaps: list[list] = [[] for _ in least]

    def add(self, item: int, score: int, doc: int | None) -> None:
        entry = (score, doc is not None, -doc if doc is not None else 0)
        heap = self.heaps[item]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.least[item] = max(self.least[item], heap[0][0])

    def rows(self) -> Iterator[tuple]:
        for item, heap in enumerate(self.heaps):
            for score, known, neg in heap:
                yield item, (-neg if known else None), score


def search_block(tree: ItemTree, docs: DocTree, ids: list, best: Best, scratch: np.ndarray, exact) -> int:
    """Offer every document of the block that may be among an item's best.
    Returns the number of documents whose scores were computed."""
    weakest = tree.weakest(best.least)
    scored = 0

    def reach(nodes: np.ndarray, level: int, node: int) -> np.ndarray:
        ptr, terms, coords = docs.levels[level]
        here = slice(ptr[node], ptr[node + 1])
        scratch[terms[here]] = coords[here]
        asked, begin = tree.terms(nodes)
        bound = np.add.reduceat(scratch[asked], begin)
        nodes = nodes[bound >= weakest[nodes]]
        if level and len(nodes):  # one step down the item tree for each down the documents'
            nodes = tree.below(nodes)
            asked, begin = tree.terms(nodes)
            nodes = nodes[np.add.reduceat(scratch[asked], begin) >= weakest[nodes]]
        while not level and len(nodes) and tree.inner[nodes].any():
            nodes = tree.below(nodes)
            asked, begin = tree.terms(nodes)
            nodes = nodes[np.add.reduceat(scratch[asked], begin) >= weakest[nodes]]
        scratch[terms[here]] = 0
        return nodes

    stack = [(len(docs.levels) - 1, 0, np.array([tree.root]))]
    while stack:
        level, node, nodes = stack.pop()
        nodes = reach(nodes, level, node)
        if not len(nodes):
            continue
        if level:
            last = len(docs.levels[level - 1][0]) - 1
            stack += [(level - 1, c, nodes) for c in reversed(range(node * FAN, min(last, (node + 1) * FAN)))]
            continue
        lo, hi = node * LEAF, min(len(docs.docs), (node + 1) * LEAF)
        here = slice(docs.begins[lo], docs.begins[hi])
        terms = np.unique(docs.terms[here])
        rows = np.zeros((hi - lo, len(terms)), exact)
        rows[docs.at[here] - lo, np.searchsorted(terms, docs.terms[here])] = docs.coords[here]
        asked, begin = tree.terms(nodes)
        col = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        held = terms[col] == asked
        wanted = np.zeros((len(nodes), len(terms)), exact)
        wanted[np.repeat(np.arange(len(nodes)), np.diff(np.r_[begin, len(asked)]))[held], col[held]] = 1
        scores = (rows @ wanted.T).astype(np.int64)
        scored += hi - lo
        for r, j in zip(*np.nonzero(scores >= weakest[nodes][None, :])):
            best.add(tree.order[nodes[j]], int(scores[r, j]), ids[docs.docs[lo + r]])
        weakest = tree.weakest(best.least)
    return scored


# --- Spark ------------------------------------------------------------------

BLOCKS = "kind int, n_docs long, n_terms long, ids array<long>, lengths binary, counts binary, rows binary, terms binary, df binary"


def term_blocks(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Blocks (kind 0) of documents with their counts of the vocabulary's
    terms, and of each task (kind 1) its document frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        vocab = shared.value
        df = np.zeros(len(vocab), np.int64)
        for b in batches:
            h, first = term_hashes(b.column(1))
            n = np.diff(first)
            at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
            known = vocab[at] == h
            key = np.repeat(np.arange(len(n)), n)[known] * np.int64(len(vocab)) + at[known]
            key, tf = np.unique(key, return_counts=True)
            row, term = key // len(vocab), key % len(vocab)
            df += np.bincount(term, minlength=len(vocab))
            held = np.unique(row)  # only documents that some item may find
            ids = b.column(0).take(pa.array(held)).to_pylist()
            packed = [[pack(x.astype(np.int64))] for x in (n[held], tf, np.searchsorted(held, row), term)] if ids else [[None]] * 4
            yield [[0], [int((n > 0).sum())], [int(n.sum())], [ids], *packed, [None]]
        if df.any():
            yield [[1], [0], [0], [None], [None], [None], [None], [None], [pack(df)]]

    return stored(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), BLOCKS, run), "term-blocks")


def frequencies(blocks: DataFrame, n_terms: int, parts: int = 16) -> np.ndarray:
    """Documents of each term, added up in parts of the vocabulary."""
    width = -(-n_terms // parts)
    parts = -(-n_terms // width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for df in b.column(0).to_pylist():
                total += unpack(df, "<i8")
        if total.any():
            yield [range(parts), [pack(total[i * width:(i + 1) * width]) for i in range(parts)]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, df in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + unpack(df, "<i8")
        if sums:
            yield [list(sums), [pack(x) for x in sums.values()]]

    ddl = "part int, df binary"
    rows = map_batches(blocks.where("kind = 1").select("df"), ddl, cut)
    out = np.zeros(n_terms, np.int64)
    for r in map_batches(rows.repartition(parts, "part"), ddl, add).collect():
        out[r["part"] * width:(r["part"] + 1) * width] = unpack(r["df"], "<i8")
    return out


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def coordinates(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _searched(blocks: DataFrame, sets: list[np.ndarray], w: np.ndarray, n_docs: int, n_terms: int,
              least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the k best of each item."""
    exact = np.float64 if int(w.max(initial=0)) * 1_000_000 * max(map(len, sets)) < 1 << 53 else np.int64
    shared = blocks.sparkSession.sparkContext.broadcast((sets, w, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        sets, w, least = shared.value
        tree, best, scratch = ItemTree(sets, w), Best(least.copy(), k), np.zeros(len(w), np.int64)
        for b in batches:
            for ids, lengths, counts, rows, terms in zip(*(b.column(i).to_pylist() for i in range(5))):
                n, tf, rows, terms = (unpack(x, "<i8") for x in (lengths, counts, rows, terms))
                m = 100 - 90 + (90 * n * n_docs) // n_terms
                c = coordinates(w[terms], tf, m[rows])
                if (c > 0).any():
                    some = c > 0
                    search_block(tree, DocTree(rows[some], terms[some], c[some], len(n), len(w)), ids, best, scratch, exact)
        yield transposed(list(best.rows()), 3)

    part = blocks.where("kind = 0 and size(ids) > 0").select("ids", "lengths", "counts", "rows", "terms")
    return map_batches(part, "item long, doc_id long, score long", run)


def _top(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _shard(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    got = items.toArrow()
    ids = got.column("item_id").to_pylist()
    # values of a list column of longs, one item after the other
    lists = got.column("terms").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    vocabulary = np.unique(flat)
    cuts = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
    sets = [np.unique(x) for x in np.split(np.searchsorted(vocabulary, flat), cuts)]
    if not len(vocabulary):
        return None
    blocks = term_blocks(docs, vocabulary)
    n = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n[0]:
        return None
    w = weights(n[0], frequencies(blocks, len(vocabulary)))
    least = np.ones(len(sets), np.int64)
    seeds = blocks.where(F.pmod(F.xxhash64("ids"), F.lit(SEED_SHARE)) == 0)
    for r in _top(_searched(seeds, sets, w, n[0], n[1], least, k), k).where(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    top = stored(_top(_searched(blocks, sets, w, n[0], n[1], least, k), k), "ranked")
    names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    return top.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item."""
    terms = stored(item_terms(items), "item-terms")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    shards = max(1, -(-total // shard_terms))
    number = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(shards))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for s in range(shards):
        part = _shard(docs, terms.where(number == s), k)
        out = out if part is None else out.unionByName(part)
    return out


#: The same rows by joins of all counted terms.
SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sizes AS (SELECT row, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM words) GROUP BY row, term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, total GROUP BY term, nd),
scores AS (
  SELECT i.item_id, s.row, s.doc_id,
         CAST(sum(g.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 90 + (90 * s.n * t.nd) // t.nt)))) AS BIGINT) AS score
  FROM items i JOIN counts c USING (term) JOIN weighed g USING (term) JOIN sizes s ON s.row = c.row CROSS JOIN total t
  GROUP BY i.item_id, s.row, s.doc_id),
placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank,
         doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
