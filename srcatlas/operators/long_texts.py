"""Separator-aware chunking of long documents by many tasks.

``split_long`` gives the chunks of ``chunking.split_recursive``. Three facts make it
divisible:

* Where pieces begin depends on the nearest separators only. A block of the
  text that knows the last cut of each separator before it, and some text
  after it, finds the pieces that begin in it.
* Which window follows one that begins at a given cut depends on that cut
  alone and on less than two windows of text.
* So a block can say, for every cut at which a window may enter it, where the
  first window beyond it begins and how many chunks lie between. Followed from
  block to block, these tables give each block its entry and its first chunk
  number; no task holds more of the document than the one that reads its row.

The reading task only looks for separators and copies the text into blocks;
a block carries ``2 * size`` characters and a separator beyond its end.

``split_long_buffered`` gives those of ``chunking.split_buffered``. Where a
buffer ends depends on where it began and on the line end after it, so the
reading task finds the buffers by one search each and sends whole ones to
blocks; blocks are split by themselves, counted, and numbered by the sum of the
counts before. One buffer is never divided: a line is one task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a block; documents of more than four are cut by blocks.
BLOCK_CHARS = 1 << 20

_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)
_KEYS = ["doc_id", "block"]
_BLOCKS = ("doc_id string, repo_id string, repo string, source_file string, block int, lo long, hi long, length long, "
           "last array<long>, text string")
_TABLES = "doc_id string, block int, lo long, hi long, entry array<long>, exit array<long>, chunks array<long>"
_ENTRIES = "doc_id string, block int, start long, first_num long"
_COLUMNS = ["doc_id", "repo_id", "repo", "file_path", "content"]
_RAW = "doc_id string, repo_id string, repo string, source_file string, chunk_num int, content string"


def divisible(size: int, overlap: int, separators: Sequence[str], block_chars: int) -> bool:
    """Whether blocks can be cut by themselves: the last separator is the
    empty one, and only the first one may be longer than a character."""
    return (1 < size <= block_chars and 0 <= overlap < size and len(separators) > 1 and separators[-1] == ""
            and separators[0] != "" and all(len(s) == 1 for s in separators[1:-1]))


def text_blocks(text: str, size: int, separators: Sequence[str], block_chars: int) -> Iterator[tuple]:
    """(block, lo, hi, last, text) of each block: the last place of each
    separator before the block (-1: none), and its text with what follows."""
    beyond = 2 * size + len(separators[0])
    last = [-1] * (len(separators) - 1)
    ahead = text.find(separators[0])
    for block, lo in enumerate(range(0, len(text), block_chars)):
        hi = min(lo + block_chars, len(text))
        yield block, lo, hi, list(last), text[lo:hi + beyond]
        while 0 <= ahead < hi:          # matches do not overlap, also across blocks
            last[0] = ahead
            ahead = text.find(separators[0], ahead + len(separators[0]))
        for k, sep in enumerate(separators[1:-1], 1):
            at = text.rfind(sep, lo, hi)
            last[k] = at if at >= 0 else last[k]


class Windows:
    """The cuts in and just after a block, and the windows that begin there."""

    def __init__(self, text: str, lo: int, hi: int, length: int, last: Sequence[int], size: int, overlap: int,
                 separators: Sequence[str]):
        self.text, self.lo, self.hi = text, lo, hi
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self._inked = np.concatenate([[0], np.cumsum(~np.isin(points, _SPACES))])
        cuts, born = self._pieces(points, length, last, size, separators)
        level = np.maximum(born[:-1], born[1:])
        # a run of pieces begins where the level changes or a longer piece ended
        begins = np.concatenate([[True], (level[1:] != level[:-1]) | (born[1:-1] < level[1:])])
        run_ends = np.append(np.flatnonzero(begins)[1:], len(level))
        run_end = run_ends[np.cumsum(begins) - 1]
        self.cuts = cuts
        self.a, self.b = np.searchsorted(cuts, (lo, hi))
        i = np.arange(self.a, self.b)
        over = np.searchsorted(cuts, cuts[i] + size, "right")   # the first cut that is too far
        whole = over > run_end[i]
        over = np.where(whole, run_end[i], over)
        before = over - 1
        step = np.maximum(np.searchsorted(cuts, cuts[before] - overlap), np.minimum(np.searchsorted(cuts, cuts[over] - size), before))
        self.end = np.where(whole, cuts[over], cuts[before])
        self.next = np.where(whole, over, step)

    def _pieces(self, points: np.ndarray, length: int, last: Sequence[int], size: int, separators: Sequence[str]):
        """Sorted cuts and, for each, the separator that made it. The first
        may lie before the block; a piece that the text does not end counts
        as long, which it is wherever that matters."""
        lo, sep = self.lo, separators[0]
        known = lo + len(self.text)
        found, at = [], self.text.find(sep, max(0, last[0] + len(sep) - lo) if last[0] >= 0 else 0)
        while at >= 0:
            found.append(lo + at)
            at = self.text.find(sep, at + len(sep))
        inner = np.array([x for x in found if x > 0], np.int64)
        cuts = np.unique(np.concatenate([[max(last[0], 0)], inner, [known if known == length else known + size]]).astype(np.int64))
        born = np.zeros(len(cuts), np.int64)
        for k, sep in enumerate(separators[1:], 1):
            if sep:
                new = np.flatnonzero(points == ord(sep)) + lo
                new = np.concatenate([[last[k]], new]) if last[k] > cuts[0] else new
            else:
                new = np.arange(lo, known)
            piece = np.searchsorted(cuts, new, "right") - 1
            inside = (piece >= 0) & (piece < len(cuts) - 1)
            new, piece = new[inside], piece[inside]
            new = new[(cuts[piece + 1] - cuts[piece] >= size) & (new > cuts[piece])]
            cuts, born = np.concatenate([cuts, new]), np.concatenate([born, np.full(len(new), k)])
            order = np.argsort(cuts, kind="stable")
            cuts, born = cuts[order], born[order]
        return cuts, born

    def _filled(self) -> np.ndarray:
        return self._inked[self.end - self.lo] > self._inked[self.cuts[self.a:self.b] - self.lo]

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, exit, chunks): from the cuts up to an entry, down to the
        entry before it, one comes out at the same exit by as many chunks."""
        jump, n = np.arange(len(self.cuts)), np.zeros(len(self.cuts), np.int64)
        jump[self.a:self.b], n[self.a:self.b] = self.next, self._filled()
        while (jump[self.a:self.b] < self.b).any():
            n, jump = n + np.where(jump < self.b, n[jump], 0), jump[jump]
        entries = slice(self.a, self.a + np.searchsorted(self.cuts[self.a:self.b], self.lo + size, "right") if self.lo else self.a + 1)
        entry, exit_, n = self.cuts[entries], self.cuts[jump[entries]], n[entries]
        differs = np.append((exit_[1:] != exit_[:-1]) | (n[1:] != n[:-1]), True) if len(entry) else np.zeros(0, bool)
        return entry[differs], exit_[differs], n[differs]

    def chunks(self, start: int) -> Iterator[str]:
        """The chunks of the windows from ``start`` on that begin in the block."""
        at = int(np.searchsorted(self.cuts, start))
        while at < self.b:
            piece = self.text[self.cuts[at] - self.lo:self.end[at - self.a] - self.lo].strip()
            if piece:
                yield piece
            at = int(self.next[at - self.a])


def _cutter(size: int, separators: Sequence[str], block_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, repo_id, repo, path, text in pdf.itertuples(index=False):
                for block, lo, hi, last, part in text_blocks(text, size, separators, block_chars):
                    yield pd.DataFrame([(doc_id, repo_id, repo, path, block, lo, hi, len(text), last, part)],
                                       columns=["doc_id", "repo_id", "repo", "source_file", "block", "lo", "hi", "length", "last", "text"])
    return run


def _tables(size: int, overlap: int, separators: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                w = Windows(r.text, r.lo, r.hi, r.length, r.last, size, overlap, separators)
                yield pd.DataFrame([(r.doc_id, r.block, r.lo, r.hi, *w.table(size))],
                                   columns=["doc_id", "block", "lo", "hi", "entry", "exit", "chunks"])
    return run


def follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the first window of each block of a document begins and its
    chunk number; blocks in which none begins are left out."""
    at, num, rows = 0, 0, []
    for r in pdf.sort_values("block").itertuples(index=False):
        if r.lo <= at < r.hi:
            rows.append((r.doc_id, r.block, at, num))
            i = int(np.searchsorted(r.entry, at))
            at, num = int(r.exit[i]), num + int(r.chunks[i])
    return pd.DataFrame(rows, columns=["doc_id", "block", "start", "first_num"])


def _writer(size: int, overlap: int, separators: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                w = Windows(r.text, r.lo, r.hi, r.length, r.last, size, overlap, separators)
                yield pd.DataFrame([(r.doc_id, r.repo_id, r.repo, r.source_file, r.first_num + i, c) for i, c in enumerate(w.chunks(r.start))],
                                   columns=["doc_id", "repo_id", "repo", "source_file", "chunk_num", "content"])
    return run


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks shared out over a stated number of tasks: else Spark merges tasks
    by bytes, and these have more to do than bytes to read."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEYS)


def split_long(documents: DataFrame, size: int, overlap: int, separators: Sequence[str],
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, repo_id, repo, source_file, chunk_num, content) of documents
    (doc_id, repo_id, repo, file_path, content); ``doc_id`` is their key."""
    if not divisible(size, overlap, separators, block_chars):
        raise ValueError("these sizes or separators do not allow cutting by blocks")
    blocks = _dealt(documents.select(*_COLUMNS).mapInPandas(_cutter(size, separators, block_chars), _BLOCKS))
    tables = blocks.select("doc_id", "block", "lo", "hi", "length", "last", "text").mapInPandas(_tables(size, overlap, separators), _TABLES)
    entries = tables.groupBy("doc_id").applyInPandas(follow, _ENTRIES)
    return blocks.join(entries.hint("shuffle_hash"), _KEYS).mapInPandas(_writer(size, overlap, separators), _RAW)


def buffer_blocks(text: str, size: int, block_chars: int = BLOCK_CHARS) -> Iterator[str]:
    """Runs of whole buffers of at least ``block_chars`` characters (the last
    may be shorter)."""
    lo = hi = 0
    while lo < len(text):
        while hi < len(text) and hi - lo < block_chars:
            hi = text.find("\n", hi + 2 * size - 1) + 1 or len(text)
        yield text[lo:hi]
        lo = hi


def split_long_buffered(documents: DataFrame, size: int, overlap: int, split: Callable[[str, int, int], list[str]],
                        block_chars: int = BLOCK_CHARS) -> DataFrame:
    """As ``split_long``, by ``split`` (``chunking.split_buffered``)."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *of, text in pdf.itertuples(index=False):
                for block, part in enumerate(buffer_blocks(text, size, block_chars)):
                    yield pd.DataFrame([(*of, block, part)], columns=["doc_id", "repo_id", "repo", "source_file", "block", "text"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[_KEYS].assign(n=[len(split(t, size, overlap)) for t in pdf["text"]])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame([(r.doc_id, r.repo_id, r.repo, r.source_file, r.first_num + i, c) for i, c in enumerate(split(r.text, size, overlap))],
                                   columns=["doc_id", "repo_id", "repo", "source_file", "chunk_num", "content"])

    blocks = _dealt(documents.select(*_COLUMNS).mapInPandas(cut, "doc_id string, repo_id string, repo string, source_file string, block int, text string"))
    counts = blocks.select(*_KEYS, "text").mapInPandas(count, "doc_id string, block int, n long")
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("block")) - F.col("n")
    firsts = counts.select(*_KEYS, before.alias("first_num"))
    return blocks.join(firsts.hint("shuffle_hash"), _KEYS).mapInPandas(write, _RAW)
