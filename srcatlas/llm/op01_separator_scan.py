"""Token counts by a separator scan over flat, unindexed token files.

A flat file is a row of little-endian unsigned 16-bit ids, each document
followed by the end-of-document id; nothing says where documents begin.
Files are cut into blocks of equal size that are scanned independently: one
vectorised comparison finds the separators of a block. A document may run
over any number of blocks, so each block yields only its separators' places
and its totals; a two-level prefix scan over the blocks of a file carries the
number of documents, the ids and the last separator before each block, and
stitches the documents together.

Defined results: a null text counts as empty (a document of 0 tokens); ids
after a file's last separator are one more document, ``closed`` false; a null
``doc_id`` stays null; repeated rows are counted each; an empty table gives
no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exclusive_prefix, map_batches, scratch_path, stored
from .op08_frames import make_folder, open_file
from .tokens import encoder

ID = np.dtype("<u2")
#: Bytes of one block of a flat file.
BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write each partition's documents as one flat file; returns the
    committed list (path, place, doc_id), which holds no offsets. Files of
    lost or repeated tasks are not in it and are never read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        path, out, place = f"{folder}/{uuid.uuid4().hex}.ids", None, 0
        for b in batches:
            if not b.num_rows:
                continue
            out = out or open_file(path, True)
            for ids in encoder(tokenizer).batch(b.column(1)):
                if len(ids) and int(ids.max()) >= end_id:
                    raise ValueError("an id of the text is not below the end-of-document id")
                out.write(np.append(ids, np.uint32(end_id)).astype(ID).tobytes())
            yield [[path] * b.num_rows, np.arange(place, place + b.num_rows), b.column(0)]
            place += b.num_rows
        if out is not None:
            out.close()

    make_folder(folder)
    return stored(map_batches(docs.select("doc_id", "text"), "path string, place long, doc_id long", run), "flat-names")


def flat_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, at, size) for files (path, length): where to read."""
    n = F.floor((F.col("length") + (block_bytes - 1)) / F.lit(block_bytes)).cast("long")
    return files.where("length > 0").select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block")).select(
        "path", "block", (F.col("block") * block_bytes).alias("at"),
        F.least(F.lit(block_bytes).cast("long"), F.col("length") - F.col("block") * block_bytes).alias("size"))


def scan_blocks(blocks: DataFrame, end_id: int) -> DataFrame:
    """For each block its number of ids and its separators' places in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            for row in b.to_pylist():
                with open_file(row["path"], False) as source:
                    source.seek(row["at"])
                    ids = np.frombuffer(source.read(row["size"]), ID)
                yield [[row["path"]], [row["block"]], [len(ids)], [np.flatnonzero(ids == end_id)]]

    return map_batches(blocks, "path string, block long, n_ids long, places array<long>", run)


def stitch(scanned: DataFrame) -> DataFrame:
    """Documents of every file: (path, place, start, n_tokens, closed);
    ``start`` counts the file's ids before it, separators included."""
    flat = scanned.select(
        "path", "block", "n_ids", F.size("places").cast("long").alias("n_docs"),
        F.when(F.size("places") > 0, F.element_at("places", -1)).alias("last_in"))
    base = exclusive_prefix(flat, ["path"], "block", {"ids_before": "n_ids", "place0": "n_docs"})
    base = base.withColumn("last_at", F.col("ids_before") + F.col("last_in"))
    carried = exclusive_prefix(base, ["path"], "block", {}, {"prev_end": "last_at"}).select(
        "path", "block", "ids_before", "place0", "prev_end")
    each = scanned.join(carried, ["path", "block"]).select(
        "path", "place0", "ids_before", F.coalesce("prev_end", F.lit(-1).cast("long")).alias("prev_end"), "places",
        F.posexplode("places").alias("k", "at"))
    before = F.when(F.col("k") == 0, F.col("prev_end")).otherwise(
        F.col("ids_before") + F.get("places", F.col("k") - 1))
    closed = each.select(
        "path", (F.col("place0") + F.col("k")).alias("place"), (before + 1).alias("start"),
        (F.col("ids_before") + F.col("at") - before - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = base.groupBy("path").agg(
        F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("place"),
        F.coalesce(F.max("last_at") + 1, F.lit(0)).alias("start"))
    open_ = ends.where("n_ids > start").select(
        "path", "place", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_)


def flat_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the flat files below ``folder``, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "length")


def count_tokens(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scan flat files (path, length) and return their documents."""
    if block_bytes % ID.itemsize:
        raise ValueError("a block holds whole ids")
    blocks = flat_blocks(files, block_bytes)
    n = blocks.count()
    scanned = stored(scan_blocks(blocks.repartition(max(1, n // 4)), end_id), "flat-scan")
    return stitch(scanned)


def documents_counted(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, closed of every document: written flat, scanned
    back, and named by place."""
    folder = scratch_path(spark, "flat")
    names = write_flat(docs, folder, tokenizer, end_id)
    file = F.element_at(F.split("path", "/"), -1)
    named = names.select(file.alias("file"), "place", "doc_id")
    files = flat_files(spark, folder).withColumn("file", file).join(
        named.select("file").distinct(), "file", "left_semi").select("path", "length")
    counted = count_tokens(files, end_id).withColumn("file", file)
    return counted.join(named, ["file", "place"]).select("doc_id", "n_tokens", "closed")
