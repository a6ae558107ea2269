"""File-tree scan as a Spark Python data source, and the bytes -> text step.

``spark.read.format("source_tree").option("paths", "/repos/a,/repos/b")``
lists every regular file under the roots (dotfiles, ``__init__.py``,
``_private/`` dirs and empty files included). The driver lists only the
top directory levels (names, breadth-first, until there are enough
shards); each input partition walks its share of those subtrees on an
executor, so listing a corpus of millions of files is spread over the
cluster. ``size_bytes`` bounds are pushed into the scan
(no bytes are read for files outside them), and ``content=false`` gives a
listing pass without bytes: filter the listing, then ``read_contents``.

``list_tree`` lists in rounds instead: each round's folders are a DataFrame
whose tasks list them and find the next round's, so the driver knows the roots
only, however many folders or names there are. ``ingest_files`` uses it.

Nothing is skipped unseen: a root that does not exist raises, and what cannot
be listed or read is a row with ``error``. Roots must be mounted at the same
path on the driver and all executors.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual,
                                    InputPartition, LessThan, LessThanOrEqual)

from .. import constants as K
from ..session import scratch_table

TREE_SCHEMA = ("repo string, repo_source string, rel_path string, size_bytes bigint, "
               "modified timestamp, content binary, error string")


class _Shard(InputPartition):
    def __init__(self, index: int, items: list[tuple[str, str, bool]]):
        super().__init__(index)
        self.items = items


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        paths = options.get("paths") or options.get("path") or ""
        self.roots = [p.rstrip("/") or "/" for p in paths.split(",") if p]
        self.shards = int(options.get("shards") or 64)
        self.with_content = str(options.get("content", "true")).lower() == "true"
        self.lo: int | None = None   # size_bytes >= lo
        self.hi: int | None = None   # size_bytes <= hi

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("size_bytes",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, LessThanOrEqual):
                    self.hi = f.value if self.hi is None else min(self.hi, f.value)
                    continue
                if isinstance(f, LessThan):
                    self.hi = f.value - 1 if self.hi is None else min(self.hi, f.value - 1)
                    continue
                if isinstance(f, GreaterThanOrEqual):
                    self.lo = f.value if self.lo is None else max(self.lo, f.value)
                    continue
                if isinstance(f, GreaterThan):
                    self.lo = f.value + 1 if self.lo is None else max(self.lo, f.value + 1)
                    continue
            yield f

    def partitions(self):
        """Shards of the tree. Directories are expanded breadth-first on the
        driver (names only, no file stats) until there are ``shards * 8``
        items, so a repository with everything under one
        folder is still spread over many tasks. An item is a file, a
        directory walked whole, or a directory's own files only."""
        target = self.shards * 8
        items: list[tuple[str, str, bool]] = []   # (root, rel, recursive)
        for root in self.roots:
            if not os.path.isdir(root):
                raise FileNotFoundError(f"no such folder: {root}")
        frontier: list[tuple[str, str]] = [(root, "") for root in self.roots]
        while frontier:
            nxt: list[tuple[str, str]] = []
            for root, rel in frontier:
                base = os.path.join(root, rel) if rel else root
                try:
                    names = sorted(os.listdir(base))
                except OSError:
                    items.append((root, rel, True))     # the task reports it
                    continue
                for n in names:
                    r = f"{rel}/{n}" if rel else n
                    full = os.path.join(root, r)
                    if os.path.isdir(full) and not os.path.islink(full):
                        nxt.append((root, r))
                    else:
                        items.append((root, r, False))
            if len(items) + len(nxt) >= target:
                items += [(root, r, True) for root, r in nxt]
                break
            frontier = nxt
        n = max(1, min(self.shards, len(items)))
        buckets: list[list[tuple[str, str, bool]]] = [[] for _ in range(n)]
        for it in items:
            buckets[zlib.crc32(f"{it[0]}/{it[1]}".encode()) % n].append(it)
        return [_Shard(i, b) for i, b in enumerate(buckets)]

    @staticmethod
    def _failed(root: str, path: str, error: OSError):
        rel = os.path.relpath(path, root).replace(os.sep, "/")
        return (os.path.basename(root), root, rel, None, None, None, f"{type(error).__name__}: {error.strerror}")

    def _row(self, root: str, path: str):
        try:
            st = os.lstat(path)
            if not stat.S_ISREG(st.st_mode):
                return None
            if (self.lo is not None and st.st_size < self.lo) or (self.hi is not None and st.st_size > self.hi):
                return None
            data = None
            if self.with_content:
                with open(path, "rb") as fh:
                    data = fh.read()
        except OSError as e:
            return self._failed(root, path, e)
        rel = os.path.relpath(path, root).replace(os.sep, "/")
        return (os.path.basename(root), root, rel, st.st_size,
                datetime.fromtimestamp(st.st_mtime, tz=timezone.utc).replace(tzinfo=None), data, None)

    def read(self, partition: _Shard):
        for root, rel, recursive in partition.items:
            top = os.path.join(root, rel)
            if recursive:
                failed: list[OSError] = []
                for d, dirs, files in os.walk(top, onerror=failed.append):
                    dirs.sort()
                    for fname in sorted(files):
                        r = self._row(root, os.path.join(d, fname))
                        if r is not None:
                            yield r
                for e in failed:
                    yield self._failed(root, e.filename, e)
            else:
                r = self._row(root, top)
                if r is not None:
                    yield r


class SourceTreeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema):
        return _TreeReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTreeDataSource)


def scan_tree(spark: SparkSession, roots: list[str], content: bool = True, shards: int | None = None) -> DataFrame:
    """All files below ``roots``; by default in four tasks for each core."""
    register(spark)
    shards = shards or 4 * spark.sparkContext.defaultParallelism
    return (spark.read.format("source_tree").option("paths", ",".join(roots))
            .option("content", str(content).lower()).option("shards", str(shards)).load())


LISTING = "repo string, repo_source string, rel_path string, size_bytes bigint, modified timestamp, error string, folder boolean"


def _entries(root: str, rel: str) -> Iterator[tuple]:
    """Rows of LISTING for what stands in one folder; links are not followed,
    and what is neither a file nor a folder is left out."""
    repo, top = os.path.basename(root), os.path.join(root, rel) if rel else root

    def failed(path: str, e: OSError) -> tuple:
        return repo, root, path, None, None, f"{type(e).__name__}: {e.strerror}", False

    try:
        with os.scandir(top) as entries:
            for entry in entries:
                path = f"{rel}/{entry.name}" if rel else entry.name
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield repo, root, path, None, None, None, True
                    elif entry.is_file(follow_symlinks=False):
                        st = entry.stat(follow_symlinks=False)
                        yield repo, root, path, st.st_size, datetime.fromtimestamp(st.st_mtime, tz=timezone.utc), None, False
                except OSError as e:
                    yield failed(path, e)
    except OSError as e:
        yield failed(rel or ".", e)


def list_tree(spark: SparkSession, roots: list[str], batch_rows: int = 8192) -> DataFrame:
    """Every regular file below ``roots`` without its bytes (the columns of
    ``scan_tree`` but ``content``), listed in rounds: one for each level of
    folders. A round's folders are dealt over the cluster; a task streams a
    folder's names in batches of ``batch_rows``, so one of a million files is
    no more than that in memory. What a round found is kept in the checkpoint
    folder, so a lost executor does not list the levels above again."""
    roots = [r.rstrip("/") or "/" for r in roots]
    for root in roots:
        if not os.path.isdir(root):
            raise FileNotFoundError(f"no such folder: {root}")
    names = [c.split()[0] for c in LISTING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        for b in batches:
            for root, rel in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in _entries(root, rel):
                    rows.append(row)
                    if len(rows) >= batch_rows:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.string(), pa.bool_()]
    frontier, found = spark.createDataFrame([(r, "") for r in dict.fromkeys(roots)], "repo_source string, rel_path string"), None
    while True:
        dealt = frontier.select("repo_source", "rel_path").repartition("repo_source", "rel_path")
        listed, _ = scratch_table(dealt.mapInArrow(run, LISTING), "listing")
        files = listed.where("not folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        frontier = listed.where("folder")
        if frontier.isEmpty():
            return found


def readable(listing: DataFrame, on_error: str = "raise") -> DataFrame:
    """The rows without ``error``. With ``on_error`` "raise" (the default) an
    unreadable item fails the job; "skip" leaves it out (see it in the listing)."""
    if on_error not in ("raise", "skip"):
        raise ValueError(f"unknown on_error {on_error!r}")
    failed = F.col("error").isNotNull()
    if on_error == "raise":
        failed = F.when(failed, F.raise_error(F.concat_ws(" ", "repo_source", "rel_path", "error"))).otherwise(F.lit(False)).cast("boolean")
    return listing.where(~failed)


def read_contents(listing: DataFrame, max_batch_bytes: int = 64 << 20) -> DataFrame:
    """Second pass: bytes of the listed (already filtered) files, read in
    executor batches; an output batch is flushed once it holds
    ``max_batch_bytes`` of file content, so memory stays bounded however
    many files a listing batch names."""
    schema = listing.drop("content").schema.add("content", "binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop(columns=["content"], errors="ignore").reset_index(drop=True)
            start, data, held = 0, [], 0
            for i, (root, rel) in enumerate(zip(pdf["repo_source"], pdf["rel_path"])):
                with open(os.path.join(root, rel), "rb") as fh:
                    data.append(fh.read())
                held += len(data[-1])
                if held >= max_batch_bytes:
                    yield pdf.iloc[start:i + 1].assign(content=data)
                    start, data, held = i + 1, [], 0
            if start < len(pdf):
                yield pdf.iloc[start:].assign(content=data)
    return listing.drop("content").mapInPandas(run, schema)


def head(content: Column, n: int = K.SNIFF_BYTES) -> Column:
    return F.substring(content, 1, n)


def decode_text(bytes_col: Column) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else Latin-1 (never fails);
    newlines normalised to ``\\n``. Malformed bytes never raise."""
    as_utf8 = F.try_validate_utf8(bytes_col.cast("string"))
    txt = F.coalesce(as_utf8, F.decode(bytes_col, "ISO-8859-1"))
    return F.regexp_replace(txt, r"\r\n?", "\n")


def ingest_files(spark: SparkSession, roots: list[str], policy: str = "ingest", strict_reference: bool = False,
                 max_bytes: int | str | None = "reference", on_error: str = "raise") -> DataFrame:
    """Listing -> cheap path/size rules -> read bytes -> content sniff ->
    decoded ``content``. Returns the kept files with text content."""
    from ..operators import files as fo
    listing = readable(list_tree(spark, roots), on_error)
    cheap = listing.where(fo.policy_reason(listing, policy, strict_reference=strict_reference, max_bytes=max_bytes).isNull())
    with_bytes = read_contents(cheap).withColumn("head", head(F.col("content")))
    sniffed = fo.keep_files(with_bytes, policy, strict_reference=strict_reference, head_col="head", max_bytes=max_bytes)
    return sniffed.withColumn("content", decode_text(F.col("content"))).drop("head")
