"""Token-ID output: independent zstandard frames with a trailing seek table.

A file holds one frame for each document (its ids as little-endian unsigned
32-bit integers), a skippable frame that names the documents, and last the
seek table of the public zstd seekable format: for each frame its compressed
size, its size and a checksum (the low 32 bits of the content's xxhash64),
closed by a footer of fixed size. Plain zstd tools read the file as one
stream; a reader that wants some documents reads the footer, the tables and
then only those documents' frames.

Documents are range-partitioned and sorted by ``doc_id``; each task streams
one file, so memory is one batch and one file's tables. Tasks write to names
of their own, and a manifest that Spark commits names the files that count:
a lost or repeated task leaves at most an unread file behind.

Defined results: a null text counts as empty and has the end id only; a null
``doc_id`` sorts first and stays null; rows with equal ``doc_id`` follow by
text; repeated rows are all written; an empty table gives no files and no
rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exclusive_prefix, map_batches, scratch_path, stored, transposed
from .tokens import encoder, ids_crc32

#: Fixed values of the zstd seekable format.
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_NAMES = 0x184D2A50
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUM = 0x80
FOOTER = struct.Struct("<IBI")
HEADER = struct.Struct("<II")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
NAME = np.dtype([("doc_id", "<i8"), ("known", "u1")])

#: Bytes of text that one file is made for.
FILE_TEXT_BYTES = 32 << 20


class FrameWriter:
    """Streams documents to an open binary file."""

    def __init__(self, out: BinaryIO, level: int = 3):
        self._out, self._zstd = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self._entries: list[tuple[int, int, int]] = []
        self._names: list[tuple[int, int]] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        frame = self._zstd.compress(raw)
        self._out.write(frame)
        self._entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._names.append((0, 0) if doc_id is None else (doc_id, 1))
        self.n_tokens += len(ids)

    def close(self) -> None:
        names = np.array(self._names, NAME).tobytes()
        self._out.write(HEADER.pack(SKIPPABLE_NAMES, len(names)) + names)
        table = np.array(self._entries, ENTRY).tobytes()
        self._out.write(HEADER.pack(SKIPPABLE_TABLE, len(table) + FOOTER.size) + table
                        + FOOTER.pack(len(self._entries), HAS_CHECKSUM, SEEKABLE_MAGIC))


class FrameReader:
    """Reads chosen documents from a seekable binary file."""

    def __init__(self, source: BinaryIO):
        self._in = source
        end = source.seek(0, 2)
        source.seek(end - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUM:
            raise ValueError("no seek table with checksums at the end of the file")
        names_size, table_size = n * NAME.itemsize, n * ENTRY.itemsize
        source.seek(end - FOOTER.size - table_size - HEADER.size - names_size - HEADER.size)
        tail = source.read(names_size + table_size + 2 * HEADER.size)
        if HEADER.unpack_from(tail) != (SKIPPABLE_NAMES, names_size) \
                or HEADER.unpack_from(tail, HEADER.size + names_size) != (SKIPPABLE_TABLE, table_size + FOOTER.size):
            raise ValueError("the tables before the footer are damaged")
        self.names = np.frombuffer(tail, NAME, n, HEADER.size)
        self.entries = np.frombuffer(tail, ENTRY, n, 2 * HEADER.size + names_size)
        sizes = self.entries["packed"].astype(np.int64)
        self._at = np.cumsum(sizes) - sizes
        self._unzstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def doc_id(self, i: int) -> int | None:
        return int(self.names["doc_id"][i]) if self.names["known"][i] else None

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; only its frame is read and verified."""
        e = self.entries[i]
        self._in.seek(int(self._at[i]))
        raw = self._unzstd.decompress(self._in.read(int(e["packed"])), max_output_size=max(1, int(e["size"])))
        if len(raw) != int(e["size"]) or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(e["check"]):
            raise ValueError(f"frame {i} does not match its checksum")
        return np.frombuffer(raw, "<u4")


def open_file(path: str, write: bool):
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner, compression=None) if write else store.open_input_file(inner)


def _files_for(text: DataFrame, file_text_bytes: int) -> int:
    """How many files: by the bytes of all texts."""
    total = text.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    return max(1, -(-total // file_text_bytes))


def write_frames(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                 file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write all documents below ``folder`` in ascending ``doc_id`` order;
    returns the committed manifest (file_no, path, n_docs, n_tokens)."""
    text = docs.select("doc_id", "text")
    n = _files_for(text, file_text_bytes)
    dealt = text.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        from pyspark import TaskContext
        part, path, out, writer, n_docs = TaskContext.get().partitionId(), None, None, None, 0
        for b in batches:
            if b.num_rows and writer is None:
                path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.zst"
                out = open_file(path, True)
                writer = FrameWriter(out)
            for d, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).batch(b.column(1))):
                writer.add(d, np.append(ids, np.uint32(end_id)))
                n_docs += 1
        if writer is not None:
            writer.close()
            out.close()
            yield [[part], [path], [n_docs], [writer.n_tokens]]

    make_folder(folder)
    return stored(map_batches(dealt, "file_no int, path string, n_docs long, n_tokens long", run), "frames-manifest")


def make_folder(folder: str) -> None:
    from pyarrow import fs
    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner, recursive=True)


def read_frames(spark: SparkSession, files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(file_no, place, doc_id, ids) of the documents in ``files`` (a
    manifest); with ``wanted`` (doc_id) only those documents are decompressed."""
    if wanted is not None:
        keys = wanted.select("doc_id").where("doc_id is not null").distinct()
        names = _read(files, None).select("file_no", "path", "place", "doc_id").join(keys, "doc_id", "left_semi")
        files = names.groupBy("file_no", "path").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return _read(files, "places" if wanted is not None else "all").select("file_no", "place", "doc_id", "ids")


def _read(files: DataFrame, mode: str | None) -> DataFrame:
    cols = ["file_no", "path"] + (["places"] if mode == "places" else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            for row in b.to_pylist():
                with open_file(row["path"], False) as source:
                    r = FrameReader(source)
                    out, held = [], 0
                    for i in row["places"] if mode == "places" else range(len(r)):
                        ids = r.ids(i) if mode else None
                        out.append((row["file_no"], row["path"], i, r.doc_id(i), ids))
                        held += 0 if ids is None else len(ids)
                        if held > 1 << 20 or len(out) >= 4096:
                            yield transposed(out, 5)
                            out, held = [], 0
                    yield transposed(out, 5)

    return map_batches(files.select(*cols), "file_no int, path string, place int, doc_id long, ids array<long>", run)


def document_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from
    the files; ``start`` counts the ids of all documents before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            for row in b.to_pylist():
                with open_file(row["path"], False) as source:
                    r = FrameReader(source)
                    out, before = [], row["before"]
                    for i in range(len(r)):
                        ids = r.ids(i)
                        out.append((r.doc_id(i), before, len(ids), ids_crc32(ids)))
                        before += len(ids)
                    yield transposed(out, 4)

    numbered = files.select("path", "n_tokens", F.col("file_no").cast("long").alias("place"))
    placed = exclusive_prefix(numbered, [], "place", {"before": "n_tokens"}).select("path", "before")
    n = max(1, files.count())
    return map_batches(placed.repartition(n), "doc_id long, start long, n_tokens long, ids_crc32 long", run)


def documents_as_frames(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    folder = scratch_path(spark, "frames")
    return document_digests(write_frames(docs, folder, tokenizer, end_id))
