"""Sequence packing: bounded-space online best fit.

A packer holds a fixed number of open bins. A bitset has one bit for each
amount of free space that some open bin has, so the tightest bin for a piece
is the lowest set bit at or above its length. When no bin fits and all are
open, the fullest (the lowest set bit of all) closes first.

Pieces are dealt by hash to buckets of bounded size that are packed
independently in one task each; then the bins that stayed open are packed
once more as pieces of their own, over all buckets together, dealt out the
same way. No task ever sees more than a bounded number of pieces.

Defined results: a null text counts as empty (the end id only); a null
``doc_id`` stays null; rows with equal ``doc_id`` are told apart by a row
number and packed each; an empty table gives no rows; ties between equal
lengths are broken by a hash, so reruns pack alike; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored, transposed
from .tokens import encoder, ids_crc32

SEQUENCE_TOKENS = 4096
#: Bins that a packer holds open.
OPEN_BINS = 1024
#: Pieces of one bucket, on average: the bound of a task's work.
BUCKET_PIECES = 8192

#: row: a number for each input row; whole: one for each piece of full length.
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, whole long"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut only where it
    is longer than ``capacity``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        from pyspark import TaskContext
        row = whole = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for d, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).batch(b.column(1))):
                ids = np.append(ids, np.uint32(end_id))
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    full = len(part) == capacity
                    out.append((row, d, p, at, len(part), ids_crc32(part), whole if full else None))
                    whole += full
                row += 1
            yield transposed(out, 7)

    return stored(map_batches(docs.select("doc_id", "text"), PIECES, run), "pieces")


class BestFit:
    """Bounded-space online best fit over one stream of lengths."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self._free = 0                                  # bit f: an open bin has f free
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self._bins[free]
        b = bins.pop()
        if not bins:
            self._free &= ~(1 << free)
        return b

    def _put(self, b: int, free: int) -> None:
        if not self._bins[free]:
            self._free |= 1 << free
        self._bins[free].append(b)

    def add(self, length: int) -> tuple[int, int]:
        """The bin that takes this length, and the offset in it."""
        fits = self._free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self._open == self.open_bins:
                self._take((self._free & -self._free).bit_length() - 1)
                self._open -= 1
            b, free = self.made, self.capacity
            self.made += 1
            self._open += 1
        if free == length:
            self._open -= 1                             # full: nothing more fits
        else:
            self._put(b, free - length)
        return b, self.capacity - free

    def still_open(self) -> set[int]:
        return {b for bins in self._bins for b in bins}


def _packed(frame: pd.DataFrame, capacity: int, open_bins: int) -> pd.DataFrame:
    """Bin, offset and whether the bin stayed open. Long items come first:
    short ones then fill the gaps that these leave."""
    frame = frame.sort_values(["length", "order", "item", "sub"], ascending=[False, True, True, True], ignore_index=True)
    fit = BestFit(capacity, open_bins)
    got = [fit.add(n) for n in frame["length"].tolist()]
    left = fit.still_open()
    frame["bin"] = [b for b, _ in got]
    frame["offset"] = [o for _, o in got]
    frame["left"] = [b in left for b, _ in got]
    return frame


def _buckets(items: DataFrame, bucket_pieces: int) -> DataFrame:
    n = max(1, -(-items.count() // bucket_pieces))
    order = F.xxhash64("item", "sub")
    return items.withColumn("order", order).withColumn("bucket", F.pmod(order, F.lit(n)).cast("int"))


def _pack_buckets(items: DataFrame, capacity: int, open_bins: int, bucket_pieces: int) -> DataFrame:
    """items (item, sub, length) -> bucket, bin, offset, left."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _packed(frame, capacity, open_bins)[["item", "sub", "length", "bucket", "bin", "offset", "left"]]

    return _buckets(items, bucket_pieces).groupBy("bucket").applyInPandas(
        run, "item long, sub int, length long, bucket int, bin int, offset long, left boolean")


def pack(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS,
         bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (row, piece, length, ...)."""
    items = pieces.where(F.col("length") < capacity).select(
        F.col("row").alias("item"), F.col("piece").alias("sub"), "length")
    first = stored(_pack_buckets(items, capacity, open_bins, bucket_pieces), "packed")
    bin_id = (F.shiftleft(F.col("bucket").cast("long"), 32) + F.col("bin")).alias("bin_id")
    # once more: the bins that were still open, each as one item
    left = first.where("left").groupBy(bin_id).agg(F.sum("length").alias("length")).select(
        F.col("bin_id").alias("item"), F.lit(0).alias("sub"), "length")
    second = stored(_pack_buckets(left, capacity, open_bins, bucket_pieces), "packed-left").select(
        F.col("item").alias("bin_id"), F.shiftleft(F.col("bucket").cast("long"), 32).alias("b2"),
        F.col("bin").alias("bin2"), F.col("offset").alias("shift"))
    placed = first.select(F.col("item").alias("row"), F.col("sub").alias("piece"), bin_id, "offset").join(
        second, "bin_id", "left").select(
        "row", "piece",
        # three kinds of sequences: closed at once, packed again, whole pieces
        F.when(F.col("bin2").isNull(), F.col("bin_id") * 3).otherwise((F.col("b2") + F.col("bin2")) * 3 + 1).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    whole = pieces.where(F.col("length") == capacity).select(
        "*", (F.col("whole") * 3 + 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < capacity).join(placed, ["row", "piece"]).unionByName(whole)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_documents(docs, tokenizer, end_id)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
