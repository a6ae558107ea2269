"""Helpers shared by the operators: scratch tables, prefix scans, word arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Bytes of one Arrow batch handed to a Python task: bounds a task's memory
#: whatever the number of rows (a longer text is one batch of its own).
ARROW_BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; a smaller bound already set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key, str((1 << 31) - 1)) or 0)
    if now <= 0 or now > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    base = checkpoint_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage (lost executors re-read files instead of recomputing)
    and fixes whatever was computed, such as partition numbers."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
          "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary(),
          "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32()),
          "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()),
          "array<string>": pa.list_(pa.string())}


def arrow_types(ddl: str) -> tuple[list[str], list[pa.DataType]]:
    """Names and Arrow types of a flat "name type, name type" schema."""
    pairs = [c.split() for c in ddl.split(", ")]
    return [n for n, _ in pairs], [_ARROW[t] for _, t in pairs]


def batch_of(ddl: str, columns: Sequence) -> pa.RecordBatch:
    """An Arrow batch of the schema from one sequence for each column."""
    names, types = arrow_types(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def map_batches(df: DataFrame, ddl: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[Sequence]]) -> DataFrame:
    """``mapInArrow`` with ``fn`` from a task's batches to column sequences.
    Integers keep all 64 bits, nulls stay nulls."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: (batch_of(ddl, columns) for columns in fn(batches)), ddl)


def transposed(rows: list[tuple], width: int) -> list:
    return list(zip(*rows)) if rows else [[]] * width


def exclusive_prefix(df: DataFrame, keys: list[str], order: str, sums: dict[str, str],
                     lasts: dict[str, str] | None = None, block: int = 1024) -> DataFrame:
    """Prefix scan in two levels: per key and in ``order`` (a dense number
    from 0), each row gets the sum of ``sums`` columns over the rows before
    it and the last non-null value of ``lasts`` columns before it (null if
    none).

    Rows are scanned in blocks of ``block``; the blocks' totals are scanned
    the same way and added, so no task sees a whole long key."""
    lasts = lasts or {}
    blk, rest = "__block", [c for c in df.columns]
    d = df.withColumn(blk, F.floor(F.col(order) / F.lit(block)).cast("long"))
    inner = Window.partitionBy(*keys, blk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select(
        *rest, blk,
        *[F.coalesce(F.sum(c).over(inner), F.lit(0)).cast("long").alias(f"__s_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(inner).alias(f"__l_{n}") for n, c in lasts.items()])
    totals = df.withColumn(blk, F.floor(F.col(order) / F.lit(block)).cast("long")).groupBy(*keys, blk).agg(
        *[F.sum(c).cast("long").alias(f"__t_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__m_{n}") for n, c in lasts.items()])
    outer = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, blk,
        *[F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)).cast("long").alias(f"__c_{n}") for n in sums],
        *[F.last(f"__m_{n}", ignorenulls=True).over(outer).alias(f"__k_{n}") for n in lasts])
    cond = [blk, *keys]
    return d.join(carried, cond).select(
        *rest,
        *[(F.col(f"__s_{n}") + F.col(f"__c_{n}")).alias(n) for n in sums],
        *[F.coalesce(F.col(f"__l_{n}"), F.col(f"__k_{n}")).alias(n) for n in lasts])


def pack(x: np.ndarray) -> bytes:
    """An integer array, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype) if len(raw) else np.zeros(0, dtype)


# --- words of a batch of texts, as arrays ----------------------------------

#: The six white-space bytes \x20 \x09-\x0D; words are the runs of other bytes.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_POLY = 0xD6E8FEB86659FD93
_POLY_INV = pow(_POLY, -1, 1 << 64)
#: A 64-bit value for each byte, from splitmix64 over 1..256.
_SLICE = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE64 = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, _SLICE + 1)
        out = []
        for base in (_POLY, _POLY_INV):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def text_bytes(col: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, A-Z lower-cased, and the
    n+1 offsets of the texts. Nulls count as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if data is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]]
    return (LOWER[raw] if lower else raw), off - off[0]


def word_bounds(raw: np.ndarray, off: np.ndarray, space: np.ndarray = IS_SPACE):
    """Starts and ends of the words in ``raw`` and, for each text, the number
    of its first word (n+1 values). Words never run over a text's end."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~space[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = np.flatnonzero(off[1:] > off[:-1])
    s, e = off[:-1][full], off[1:][full] - 1
    first[s] = word[s]
    last[e] = word[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes (mod 2^64),
    mixed. Works in slices of about 2 MB, cut between words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo)
        v = _BYTE64[raw[lo:hi]]
        v *= up[:hi - lo]
        acc = np.cumsum(v, dtype=np.uint64)
        s, e = starts[i:j] - lo, ends[i:j] - 1 - lo
        h = acc[e] - acc[s] + v[s]
        h *= down[s]
        out[i:j] = mix64(h ^ ((e - s).astype(np.uint64) * _MULT))
        i = j
    return out


_GRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text's word hashes (k <= 8)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _GRAM[0]
    for i in range(1, k):
        h ^= words[i:i + n] * _GRAM[i] + np.uint64(i)
        h *= _GRAM[i] | np.uint64(1)
    return mix64(h)
