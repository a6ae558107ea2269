"""Chunking: documents -> chunks.

* ``fixed``: stride ``size - overlap`` windows computed by Catalyst: one pass
  cuts the text into stride-long pieces, a chunk is a piece and the start of
  the next; linear in the text's length, no Python, no shuffle.
* ``recursive``: separator-aware splitting (paragraph, line, word,
  character), greedy merge up to ``size`` with up to ``overlap`` characters
  carried over. Documents are split row by row (a Python function); a
  document of more than four blocks of text is itself cut over many tasks
  (``long_texts``), with the same chunks.
* ``buffered``: line-aligned buffers of at least ``2 * size`` characters,
  each split recursively, no overlap across buffers, running chunk numbers.

The mode is the caller's choice, never a matter of a document's size.

Chunk rows: ``chunk_id = doc_id || ':' || md5(content)``, ``size = length``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import long_texts

CHUNK_COLUMNS = ["chunk_id", "doc_id", "repo_id", "chunk_hash", "content", "size",
                 "chunk_num", "source_file", "repo"]


def _finish(raw: DataFrame) -> DataFrame:
    """raw(doc_id, repo_id, repo, source_file, chunk_num, content) -> chunk rows."""
    h = F.md5("content")
    return raw.select(
        F.concat(F.col("doc_id"), F.lit(":"), h).alias("chunk_id"),
        "doc_id", "repo_id", h.alias("chunk_hash"), "content",
        F.length("content").cast("int").alias("size"),
        F.col("chunk_num").cast("int").alias("chunk_num"),
        "source_file", "repo",
    )


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed_pieces(content: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """The windows of a text as an array, in one pass over it."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("the overlap must be shorter than a chunk")
    more = -(-overlap // stride)
    n = F.greatest(F.lit(1), F.ceil((F.length(content) - size) / F.lit(stride)).cast("int") + 1)

    def windows(pieces: Column) -> Column:
        return F.transform(F.slice(pieces, F.lit(1), n), lambda piece, i: F.concat(
            piece, F.substring(F.array_join(F.slice(pieces, i + 2, F.lit(more)), ""), 1, overlap)))

    cut = F.regexp_extract_all(content, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    return _let(cut, windows) if overlap else F.slice(cut, F.lit(1), n)


def fixed_count(content: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """How many windows ``fixed_pieces`` cuts, from the length alone."""
    n = F.length(content)
    return F.when(n > 0, F.greatest(F.lit(1), F.ceil((n - size) / F.lit(size - overlap)).cast("int") + 1)).otherwise(0)


def last_of_equal(pieces: Column) -> Column:
    """``pieces`` as (chunk_num, content), of equal ones the last only. Equal
    pieces stand together once (hash, number) are sorted, so the work is that
    of the sort, and nothing leaves the row."""
    marks = F.array_sort(F.transform(pieces, lambda p, i: F.struct(F.md5(p).alias("h"), i.alias("i"))))

    def kept(m: Column) -> Column:
        ends = F.transform(m, lambda x, i: F.struct(x["i"].alias("i"), F.get(m, i + 1)["h"].eqNullSafe(x["h"]).alias("again")))
        return F.filter(ends, lambda x: ~x["again"])

    numbers = F.transform(_let(marks, kept), lambda x: x["i"])
    return F.transform(numbers, lambda i: F.struct(i.alias("chunk_num"), F.get(pieces, i).alias("content")))


def chunk_fixed(documents: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP, dedup: bool = False) -> DataFrame:
    """Windows of every document; with ``dedup`` identical text within a
    document is a chunk once, its last occurrence, settled within the row."""
    of = ["doc_id", "repo_id", "repo", F.col("file_path").alias("source_file")]
    pieces = fixed_pieces(F.col("content"), size, overlap)
    if dedup:
        raw = documents.select(*of, F.explode(_let(pieces, last_of_equal)).alias("c")).select(
            "doc_id", "repo_id", "repo", "source_file", "c.chunk_num", "c.content")
    else:
        raw = documents.select(*of, F.posexplode(pieces).alias("chunk_num", "content"))
    return _finish(raw)


# --- recursive splitter (pure Python helper, one document at a time) -------

def _cuts(text: str, sep: str) -> list[int]:
    """Where the pieces of ``text`` begin and end: a piece begins with the
    separator before it; the empty separator cuts after every character."""
    if sep == "":
        return list(range(len(text) + 1))
    at, cuts = text.find(sep), [0]
    while at >= 0:
        if at > cuts[-1]:
            cuts.append(at)
        at = text.find(sep, at + len(sep))
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return cuts


def _windows(text: str, cuts: list[int], size: int, overlap: int) -> list[str]:
    """Runs of consecutive pieces of up to ``size`` characters: each begins
    as early as ``overlap`` characters before the end of the last one allow."""
    out, first = [], 0
    for last in range(1, len(cuts)):
        end = cuts[last]
        if end - cuts[first] > size and cuts[last - 1] > cuts[first]:
            done = text[cuts[first]:cuts[last - 1]].strip()
            if done:
                out.append(done)
            while cuts[last - 1] - cuts[first] > overlap or (end - cuts[first] > size and first < last - 1):
                first += 1
    rest = text[cuts[first]:cuts[-1]].strip() if cuts else ""
    if rest:
        out.append(rest)
    return out


def split_recursive(text: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                    separators: list[str] | None = None) -> list[str]:
    """Cut at the first separator that the text holds; join short pieces to
    windows, and cut pieces of ``size`` characters or more by the next
    separators. Without any left, a long piece stays whole."""
    left = list(K.RECURSIVE_SEPARATORS if separators is None else separators)
    here = next((i for i, sep in enumerate(left) if sep == "" or sep in text), len(left) - 1)
    sep, finer = left[here], [] if left[here] == "" else left[here + 1:] if left[here] in text else []
    cuts, out, run = _cuts(text, sep), [], []

    def close() -> None:
        if len(run) > 1:
            out.extend(_windows(text, run, size, overlap))
        run.clear()

    for a, b in zip(cuts, cuts[1:]):
        if b - a < size:
            if not run:
                run.append(a)
            run.append(b)
            continue
        close()
        out.extend(split_recursive(text[a:b], size, overlap, finer) if finer else [text[a:b]])
    close()
    return out


def split_buffered(text: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> list[str]:
    """Line-aligned buffers closed at >= 2*size chars, each split on its own."""
    out: list[str] = []
    buf: list[str] = []
    n = 0
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if i < len(lines) - 1:
            line += "\n"
        elif not line:
            break
        buf.append(line)
        n += len(line)
        if n >= 2 * size:
            out.extend(split_recursive("".join(buf), size, overlap))
            buf, n = [], 0
    if buf:
        out.extend(split_recursive("".join(buf), size, overlap))
    return out


def _split_whole(documents: DataFrame, size: int, overlap: int, split) -> DataFrame:
    """Chunks of documents that are one row's work each. A plain row function:
    Python holds a hundred documents at a time, however many a partition has
    (an Arrow batch holds up to 10,000, as text and as objects)."""
    pieces = F.udf(lambda content: [] if content is None else split(content, size, overlap), "array<string>", useArrow=False)
    return documents.select("doc_id", "repo_id", "repo", F.col("file_path").alias("source_file"),
                            F.posexplode(pieces("content")).alias("chunk_num", "content"))


def chunk(documents: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
          mode: str = "fixed", block_chars: int = long_texts.BLOCK_CHARS) -> DataFrame:
    """documents -> chunks. ``mode``: fixed | recursive | buffered. In
    the latter two a document of more than four times ``block_chars``
    characters is cut by blocks, so it must be the only one of its doc_id."""
    if mode == "fixed":
        return chunk_fixed(documents, size, overlap)
    if mode not in ("recursive", "buffered"):
        raise ValueError(f"unknown chunk mode {mode!r}")
    src = documents.select("doc_id", "repo_id", "repo", "file_path", "content")
    split = split_recursive if mode == "recursive" else split_buffered
    whole = lambda d: _split_whole(d, size, overlap, split)
    if mode == "recursive" and not long_texts.divisible(size, overlap, K.RECURSIVE_SEPARATORS, block_chars):
        return _finish(whole(src))
    is_long = F.length("content") > 4 * block_chars
    if mode == "recursive":
        by_blocks = long_texts.split_long(src.where(is_long), size, overlap, K.RECURSIVE_SEPARATORS, block_chars)
    else:
        by_blocks = long_texts.split_long_buffered(src.where(is_long), size, overlap, split_buffered, block_chars)
    return _finish(whole(src.where(~is_long)).unionByName(by_blocks))


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """Identical text within a document is stored once, keeping the last
    occurrence (highest ``chunk_num``). For chunks that are rows already;
    ``chunk_fixed(dedup=True)`` does it while the document is one row.

    The last numbers are found on (doc_id, chunk_hash, chunk_num) alone, a
    hash aggregate that collapses map-side; the rows themselves are then kept
    by a semi join, so no content goes through the aggregate."""
    last = chunks.groupBy("doc_id", "chunk_hash").agg(F.max("chunk_num").alias("chunk_num"))
    return chunks.join(last, ["doc_id", "chunk_hash", "chunk_num"], "left_semi")
