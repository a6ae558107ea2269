"""Files out of rows: the Python data source ``row_files``.

Each row of (file_name, content) becomes one file below ``path``. A task
writes a file under a name of its own and then renames it, so no reader sees a
half-written file, and a task that runs again writes the same bytes to the
same name. The driver, once all tasks have reported, writes ``_FILES.json``
with their number and bytes; without it, the export is not complete. Names
that lead out of ``path`` are refused.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

DONE = "_FILES.json"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def checked_name(name: str | None) -> str:
    """A relative name that stays within its folder."""
    parts = (name or "").split("/")
    if not name or name.startswith("/") or "\\" in name or any(p in ("", ".", "..") for p in parts) or name == DONE:
        raise ValueError(f"not a name for a file of an export: {name!r}")
    return name


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _put(self, store: fs.FileSystem, target: str, data: bytes) -> None:
        draft = posixpath.join(posixpath.dirname(target), f"._{uuid.uuid4().hex}")
        try:
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, target)
        except BaseException:
            if store.get_file_info(draft).type != fs.FileType.NotFound:
                store.delete_file(draft)
            raise

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        files = size = 0
        made: set[str] = set()
        for batch in iterator:
            for name, content in zip(batch.column("file_name").to_pylist(), batch.column("content").to_pylist()):
                target = posixpath.join(root, checked_name(name))
                folder = posixpath.dirname(target)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                data = b"" if content is None else content.encode("utf-8") if isinstance(content, str) else bytes(content)
                self._put(store, target, data)
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        self._put(store, posixpath.join(root, DONE), json.dumps(
            {"files": sum(m.files for m in told), "bytes": sum(m.size for m in told)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are there are whole and are written again by the next
        run; only the mark of completeness must not stay."""
        store, root = open_store(self.path)
        mark = posixpath.join(root, DONE)
        if store.get_file_info(mark).type != fs.FileType.NotFound:
            store.delete_file(mark)


class RowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "file_name string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """One file for each row of (file_name, content). Rows that share a name
    would leave whichever comes last, so they are refused."""
    rows = files.select("file_name", "content")
    twice = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one row for file {twice[0]['file_name']!r}")
    files.sparkSession.dataSource.register(RowFiles)
    rows.write.format("row_files").mode("append").option("path", path).save()
