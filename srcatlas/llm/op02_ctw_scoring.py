"""LM scoring by context-tree weighting over bytes (see ``ctw``).

A text is modelled as its lower-cased words (runs of bytes other than white
space) with one space between them and one end byte: the same tokens as the
base score's. Every byte is eight binary choices, each estimated by mixing
Krichevsky-Trofimov counts of the 0 to ``DEPTH`` bytes before it. Counts come
from the training texts; scoring changes nothing, so any text may be scored
anywhere and in any order.

How the work is dealt: a task cuts its documents into blocks of bounded size
and counts each block's grams (a context and the byte after it) and words. A
block sends its distinct grams, packed and sorted, to ranges of contexts; a
range adds up all blocks' counts, weighs its subtrees, and sends each block
the code lengths of the grams it asked for. Grams are dealt by the three
bytes before the coded one, so a range's subtrees are whole; the few contexts
above them (at most 256*256 of two bytes) are summed over all ranges. Words
and their counts go the same way. A block then scores its texts with what it
got back. All stages stream rows, so no task holds more than one block or one
range, and the model is never broadcast.

Defined results: a null or empty text has the end token only; a null
``doc_id`` stays null and is not held out; repeated rows are trained on and
scored each; without training texts every choice has probability 1/2 and
``train_tokens`` is 0; an empty table gives an empty result; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, map_batches, mix64, pack, stored, text_bytes, unpack, word_bounds
from .ctw import LOG_HALF, Subtree, level_of, log_kt, shorten

#: Bytes of context, and those by which grams are dealt.
DEPTH, DEALT = 5, 3
#: Bytes of text of one block, and of one piece of it.
BLOCK_BYTES = 48 << 20
#: Bytes of text for which there is one range of contexts more.
RANGE_BYTES = 16 << 20
END = 10
GRAMS, WORDS, TEXT = 0, 1, 2

#: kind, range or piece, block, keys or text, counts or lengths
ROWS = "kind int, part int, block long, a binary, b binary"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def canonical(texts) -> tuple[np.ndarray, np.ndarray]:
    """The modelled bytes of each text of an Arrow column, with DEPTH end
    bytes before it as its first context, and the n+1 offsets."""
    raw, off = text_bytes(texts)
    starts, ends, first = word_bounds(raw, off)
    size = ends - starts + 1
    before = np.concatenate([[0], np.cumsum(size)])
    n_words = np.diff(first)
    length = DEPTH + np.maximum(before[first[1:]] - before[first[:-1]], 1)
    offsets = np.concatenate([[0], np.cumsum(length)])
    out = np.full(offsets[-1], END, np.uint8)
    if len(starts):
        to = np.repeat(offsets[:-1] + DEPTH - before[first[:-1]], n_words) + before[:-1]
        inside = np.arange(before[-1] - len(size)) - np.repeat(before[:-1] - np.arange(len(size)), size - 1)
        out[np.repeat(to, size - 1) + inside] = raw[np.repeat(starts, size - 1) + inside]
        gap = np.ones(len(size), bool)
        gap[first[1:][n_words > 0] - 1] = False         # after a text's last word: the end
        out[(to + size - 1)[gap]] = 32
    return out, offsets


def gram_codes(text: np.ndarray) -> np.ndarray:
    """Code of each byte from DEPTH on: the byte before it first (highest),
    the oldest byte of its context just above the byte itself."""
    n = len(text) - DEPTH
    code = text[DEPTH - 1:DEPTH - 1 + n].astype(np.uint64)
    for i in range(2, DEPTH + 1):
        code = (code << np.uint64(8)) | text[DEPTH - i:DEPTH - i + n]
    return (code << np.uint64(8)) | text[DEPTH:]


def coded(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of the codes of a concatenation stand for a text's own byte."""
    own = np.ones(n, bool)
    for i in range(DEPTH):
        at = offsets[1:-1] + i - DEPTH
        own[at[(at >= 0) & (at < n)]] = False
    return own


class _Counts:
    """Sorted distinct keys with their summed counts, merged by and by."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        if not len(self.keys):
            self.keys, self.n = keys, n
            return
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        every, n = every[order], np.concatenate([self.n, n])[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.keys, self.n = every[first], np.add.reduceat(n, first)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how many of them are training ones."""
    order = np.argsort(keys, kind="stable")
    keys, train = keys[order], train[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(train.astype(np.int64), first)


def _range_of(kind: int, keys: np.ndarray, ranges: int) -> np.ndarray:
    if kind == GRAMS:
        keys = mix64(keys >> np.uint64(8 * (DEPTH - DEALT + 1)))
    return (keys % np.uint64(ranges)).astype(np.int64)


def count_blocks(docs: DataFrame, ranges: int) -> DataFrame:
    """Blocks of documents: their texts, and their grams and words by range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        from pyspark import TaskContext
        block, held = TaskContext.get().partitionId() << 24, 0
        counts = {GRAMS: _Counts(), WORDS: _Counts()}
        piece = 0

        def flush():
            rows = []
            for kind, c in counts.items():
                r = _range_of(kind, c.keys, ranges)
                order = np.argsort(r, kind="stable")
                cuts = np.searchsorted(r[order], np.arange(ranges + 1))
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if b > a:
                        rows.append((kind, i, block, pack_sorted(c.keys[order[a:b]]), pack(c.n[order[a:b]])))
                counts[kind] = _Counts()
            return list(zip(*rows))

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            text, offsets = canonical(b.column(1))
            train = np.array([not held_out(d) for d in ids])
            of = np.repeat(train, np.diff(offsets))
            own = coded(offsets, len(text) - DEPTH)
            counts[GRAMS].add(*_counted(gram_codes(text)[own], of[DEPTH:][own]))
            starts, ends, first = word_bounds(text, offsets)
            counts[WORDS].add(*_counted(hash_words(text, starts, ends), np.repeat(train, np.diff(first))))
            known = np.array([d is not None for d in ids])
            numbers = np.array([0 if d is None else d for d in ids], np.int64)
            lengths = np.concatenate([numbers, np.diff(offsets), known.astype(np.int64)])
            yield [[TEXT], [piece], [block], [zstandard.ZstdCompressor(level=1).compress(text.tobytes())], [pack(lengths)]]
            piece += 1
            held += len(text)
            if held >= BLOCK_BYTES:
                yield flush()
                block, held, piece = block + 1, 0, 0
        if held:
            yield flush()

    return stored(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ROWS, run), "ctw-blocks")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, _Counts]]:
    """(kind, range, counts) of sorted rows of one partition."""
    now, sums = None, _Counts()
    for b in batches:
        for row in b.to_pylist():
            key = (row["kind"], row["part"])
            if key != now:
                if now is not None:
                    yield *now, sums
                now, sums = key, _Counts()
            sums.add(unpack_sorted(row["a"]), unpack(row["b"], np.int64))
    if now is not None:
        yield *now, sums


TOP = "kind int, part int, choice int, node long, n0 double, n1 double, split double, a binary, b binary, total long, distinct long"


def sum_ranges(blocks: DataFrame, ranges: int) -> DataFrame:
    """Counts of each range over all blocks; for grams also its share of the
    contexts above the dealt ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for kind, part, c in _summed(batches):
            yield [[kind], [part], [None], [None], [None], [None], [None], [pack_sorted(c.keys)], [pack(c.n)],
                   [int(c.n.sum())], [int((c.n > 0).sum())]]
            if kind == GRAMS:
                for k, node, n0, n1, split in _above(Subtree(c.keys, c.n, DEALT, DEPTH)):
                    m = len(node)
                    yield [[kind] * m, [part] * m, [k] * m, node.astype(np.int64), n0, n1, split, [None] * m, [None] * m, [0] * m, [0] * m]

    rows = blocks.where(F.col("kind") != TEXT).select("kind", "part", "block", "a", "b")
    dealt = rows.repartition(ranges, "kind", "part").sortWithinPartitions("kind", "part", "block")
    return stored(map_batches(dealt, TOP, run), "ctw-ranges")


def _above(tree: Subtree) -> Iterator[tuple]:
    """What a subtree adds to the nodes one level above it."""
    low = tree.levels[tree.low]
    # a gram's count: its last choice's
    bit = (low.grams & np.uint64(1)).astype(bool)
    counts = np.where(bit, low.n1[7][low.node_of[7]], low.n0[7][low.node_of[7]])
    codes, n, up = shorten(low.grams, counts, tree.low)
    level = level_of(codes, n)
    for k in range(8):
        above = np.zeros(len(low.n0[k]), np.int64)
        above[low.node_of[k]] = level.node_of[k][up]
        split = np.bincount(above, low.log_weighted[k], len(level.n0[k]))
        first = np.zeros(len(level.n0[k]), np.int64)
        first[level.node_of[k][::-1]] = np.arange(len(codes))[::-1]
        yield k, codes[first] >> np.uint64(8 - k), level.n0[k], level.n1[k], split


class Top:
    """The contexts shorter than the dealt ones."""

    def __init__(self, nodes: pd.DataFrame):
        self.levels: list[list[tuple]] = []             # from the longest context on
        at = nodes
        for d in range(DEALT - 1, -1, -1):
            by_choice, up = [], []
            for k in range(8):
                t = at[at["choice"] == k].sort_values("node")
                node = t["node"].to_numpy().astype(np.uint64)
                n0, n1, split = (t[c].to_numpy(float) for c in ("n0", "n1", "split"))
                kt = log_kt(n0, n1)
                both = LOG_HALF + np.logaddexp(kt, split)
                by_choice.append((node, n0, n1, np.exp(LOG_HALF + kt - both)))
                if d:
                    short = ((node >> np.uint64(8 + k)) << np.uint64(k)) | (node & np.uint64((1 << k) - 1))
                    up.append(pd.DataFrame({"choice": k, "node": short, "n0": n0, "n1": n1, "split": both}))
            self.levels.append(by_choice)
            if d:
                at = pd.concat(up).groupby(["choice", "node"], as_index=False).sum()

    def mixing(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For codes of contexts of DEALT - 1 bytes: the estimate is
        ``fixed + rest * deeper`` (codes x 8 each)."""
        fixed, rest = np.zeros((len(codes), 8)), np.ones((len(codes), 8))
        chain = []
        for by_choice in self.levels:
            chain.append((by_choice, codes))
            codes = ((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(0xFF))
        for by_choice, codes in chain:
            for k, (node, n0, n1, enough) in enumerate(by_choice):
                i = np.searchsorted(node, codes >> np.uint64(8 - k))
                bit = ((codes >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
                kt = (np.where(bit, n1[i], n0[i]) + 0.5) / (n0[i] + n1[i] + 1.0)
                w = enough[i]
                fixed[:, k] = w * kt + (1 - w) * fixed[:, k]
                rest[:, k] *= 1 - w
        return fixed, rest


def log2_probabilities(keys: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """Log2 probability of each gram's byte in its context."""
    tree = Subtree(keys, n, DEALT, DEPTH)
    deep = tree.estimate()
    low = tree.levels[DEALT]
    codes, _, up = shorten(low.grams, np.zeros(len(low.grams)), DEALT)
    fixed, rest = top.mixing(codes)
    at = np.arange(len(keys))
    for d in range(DEPTH - 1, DEALT - 1, -1):
        at = tree.up[d][at]
    at = up[at]
    return np.log2(fixed[at] + rest[at] * deep).sum(1)


def answers(blocks: DataFrame, sums: DataFrame, top: Top, ranges: int) -> DataFrame:
    """For each block's grams and words of a range: keys with log2
    probabilities (grams) or training counts (words)."""
    shared = blocks.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        keys = values = None
        for b in batches:
            for row in b.to_pylist():
                mine = unpack_sorted(row["a"])
                if row["block"] is None:                # the range's sums come first
                    keys, n = mine, unpack(row["b"], np.int64)
                    values = log2_probabilities(keys, n, shared.value).astype(np.float32) if row["kind"] == GRAMS else n
                    continue
                yield [[row["kind"]], [row["part"]], [row["block"]], [row["a"]], [pack(values[np.searchsorted(keys, mine)])]]

    ask = blocks.where(F.col("kind") != TEXT).select("kind", "part", "block", "a", F.lit(None).cast("binary").alias("b"))
    have = sums.where("choice is null").select("kind", "part", F.lit(None).cast("long").alias("block"), "a", "b")
    dealt = have.unionByName(ask).repartition(ranges, "kind", "part").sortWithinPartitions("kind", "part", F.asc_nulls_first("block"))
    return map_batches(dealt, ROWS, run)


RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "n_bytes long, bits_per_byte double")


def score_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: base and model score, and the code
    length per byte."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    ranges = max(16, -(-size // RANGE_BYTES))
    blocks = count_blocks(docs, ranges)
    sums = sum_ranges(blocks, ranges)
    # at most 256 * 256 contexts of 255 nodes
    nodes = sums.where("choice is not null").groupBy("choice", "node").agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "split")]).toPandas()
    words = sums.where(f"choice is null and kind = {WORDS}").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    ids = docs.select(F.col("doc_id").cast("string").alias("d"))
    n_docs = ids.where("d is null or crc32(d) % 7 <> 2").count()
    total = (words["n"] or 0) + n_docs
    below = math.log10(total + (words["v"] or 0) + (n_docs > 0) + 1)
    got = answers(blocks, sums, Top(nodes), ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        now, tables = None, {}
        for b in batches:
            for row in b.to_pylist():
                if row["block"] != now:
                    now, tables = row["block"], {GRAMS: [], WORDS: []}
                if row["kind"] != TEXT:
                    tables[row["kind"]].append((unpack_sorted(row["a"]), unpack(row["b"], np.float32 if row["kind"] == GRAMS else np.int64)))
                    continue
                for kind, dtype in ((GRAMS, np.float32), (WORDS, np.int64)):
                    if isinstance(tables[kind], list):
                        keys = np.concatenate([k for k, _ in tables[kind]] or [np.zeros(0, np.uint64)])
                        order = np.argsort(keys, kind="stable")
                        tables[kind] = keys[order], np.concatenate([v for _, v in tables[kind]] or [np.zeros(0, dtype)])[order]
                yield _scored(row, *tables[GRAMS], *tables[WORDS], n_docs, total, below)

    texts = blocks.where(F.col("kind") == TEXT).select("kind", "part", "block", "a", "b")
    n_blocks = max(1, texts.select("block").distinct().count())
    dealt = got.unionByName(texts).repartition(n_blocks, "block").sortWithinPartitions("block", "kind", "part")
    return map_batches(dealt, RESULT, run)


def _scored(row: dict, grams: np.ndarray, log2: np.ndarray, words: np.ndarray, counts: np.ndarray,
            n_docs: int, total: int, below: float) -> list:
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["a"]), np.uint8)
    numbers, lengths, known = np.split(unpack(row["b"], np.int64), 3)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    m = len(numbers)
    doc = np.repeat(np.arange(m), lengths)[DEPTH:]
    own = coded(offsets, len(text) - DEPTH)
    codes, back = np.unique(gram_codes(text)[own], return_inverse=True)
    bits = np.bincount(doc[own], log2[np.searchsorted(grams, codes)].astype(float)[back], m)
    starts, ends, first = word_bounds(text, offsets)
    c = counts[np.searchsorted(words, hash_words(text, starts, ends))] if len(starts) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(m), np.diff(first))
    base = np.bincount(of, np.log10(c + 1) - below, m) + math.log10(n_docs + 1) - below
    n_known = np.bincount(of, c > 0, m).astype(np.int64) + (n_docs > 0)
    n_bytes = lengths - DEPTH
    ids = [int(x) if k else None for x, k in zip(numbers, known)]
    return [ids, [held_out(d) for d in ids], np.diff(first) + 1, n_known, np.full(m, total), base,
            bits * math.log10(2), n_bytes, -bits / n_bytes]
