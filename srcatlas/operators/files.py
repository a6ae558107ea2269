"""File inventory operators: policy, size classes, documents.

Input frame ``files``: one row per file with at least ``repo``,
``rel_path``, ``size_bytes`` and either ``content`` (decoded text) or
``bytes`` (raw). All operators are narrow projections/filters: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths, text

POLICIES = ("ingest", "digest", "lenient")
#: ``max_bytes`` that stands for the original tool's limit of each policy.
REFERENCE = "reference"
_REFERENCE_BYTES = {"ingest": K.INGEST_MAX_BYTES, "digest": K.DIGEST_MAX_BYTES, "lenient": K.LENIENT_MAX_BYTES}


def _ends_dot_ext(path: Column) -> Column:
    """Suffix as written, without the dot (used where case matters)."""
    return F.substring(paths.suffix(path), 2, 1 << 30)


def _sniff_reasons(head: Column, size: Column, min_share: float) -> list[tuple[str, Column]]:
    """Content checks on the first ``SNIFF_BYTES`` bytes (BINARY column)."""
    latin = F.decode(head, "ISO-8859-1")
    printable = F.length(F.regexp_replace(latin, r"[^\x20-\x7e\t\n\r]", ""))
    n = F.length(head)
    return [
        ("nul_byte", latin.contains("\u0000")),
        ("not_text", (n > 0) & (printable / n < F.lit(min_share))),
    ]


def policy_reason(files: DataFrame, policy: str = "ingest", strict_reference: bool = False,
                  path_col: str = "rel_path", size_col: str = "size_bytes",
                  head_col: str | None = None, min_printable: float = K.MIN_PRINTABLE_SHARE,
                  max_bytes: int | str | None = REFERENCE) -> Column:
    """First failing rule of ``policy`` as a string, NULL when the file is kept.
    Files above ``max_bytes`` fail; None sets no limit.

    Cheap path/name/size rules come first so the engine can skip reading
    content for rejected files; content sniffing needs ``head_col`` (bytes).
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    p = F.col(path_col)
    size = F.col(size_col)
    name = paths.base_name(p)
    e = paths.ext(p)
    parts = paths.path_parts(p)
    limit = _REFERENCE_BYTES[policy] if max_bytes == REFERENCE else max_bytes
    too_large = [] if limit is None else [("too_large", size > limit)]
    rules: list[tuple[str, Column]] = []
    if policy == "ingest":
        names = K.INGEST_SKIP_NAMES if strict_reference else [n.lower() for n in K.INGEST_SKIP_NAMES]
        rules += [
            ("skip_dir", F.arrays_overlap(parts, F.array(*[F.lit(d) for d in K.INGEST_SKIP_DIRS]))),
            ("binary_ext", e.isin(*K.INGEST_BINARY_EXT)),
            ("skip_name", F.lower(name).isin(*names)),
            ("dotfile", name.startswith(".") & ~_ends_dot_ext(p).isin(*K.DOTFILE_ALLOWED_EXT)),
            *too_large,
            ("empty", size == 0),
        ]
        if head_col:
            rules += _sniff_reasons(F.col(head_col), size, min_printable)
    elif policy == "digest":
        rules += [
            ("skip_dir", F.arrays_overlap(parts, F.array(*[F.lit(d) for d in K.DIGEST_SKIP_DIRS]))),
            ("binary_ext", e.isin(*K.DIGEST_BINARY_EXT)),
            ("dotfile", name.startswith(".")),
            *too_large,
        ]
    else:  # lenient loader
        rules += [
            ("binary_ext", e.isin(*K.LENIENT_BINARY_EXT)),
            *too_large,
        ]
    out = None
    for reason, failed in rules:
        out = F.when(failed, F.lit(reason)) if out is None else out.when(failed, F.lit(reason))
    return out.otherwise(F.lit(None).cast("string"))


def apply_policy(files: DataFrame, policy: str = "ingest", **kw) -> DataFrame:
    """Adds ``reason`` (first failing rule or NULL) and ``keep``."""
    reason = policy_reason(files, policy, **kw)
    return files.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull())


def keep_files(files: DataFrame, policy: str = "ingest", **kw) -> DataFrame:
    """Only the files the policy keeps (the filter sits below any content use)."""
    return files.where(policy_reason(files, policy, **kw).isNull())


def policy_counts(files: DataFrame, policy: str = "ingest", **kw) -> DataFrame:
    """Files per outcome: ``processable`` or the rejecting rule."""
    r = F.coalesce(policy_reason(files, policy, **kw), F.lit("processable"))
    return files.groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


def classify_sizes(files: DataFrame, size_col: str = "size_bytes") -> DataFrame:
    size = F.col(size_col)
    size_class = (F.when(size < K.SIZE_SMALL_MAX, F.lit("small"))
                  .when(size < K.SIZE_MEDIUM_MAX, F.lit("medium"))
                  .when(size < K.SIZE_LARGE_MAX, F.lit("large"))
                  .otherwise(F.lit("xlarge")))
    return files.select(
        "*",
        size_class.alias("size_class"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(size / K.BYTES_PER_ESTIMATED_CHUNK).cast("bigint")).alias("estimated_chunks"),
        (size * 3 / F.lit(float(1024 ** 2))).alias("memory_mb"),
    )


def of_size_classes(files: DataFrame, classes: tuple[str, ...] = ("small", "medium"), size_col: str = "size_bytes") -> DataFrame:
    """The files of several size classes together: by default those that are
    read at once, the others being those that are read in buffers."""
    return classify_sizes(files, size_col).where(F.col("size_class").isin(*classes))


def size_summary(files: DataFrame, size_col: str = "size_bytes") -> DataFrame:
    """Files and MB per size class; classes with no file do not appear."""
    c = classify_sizes(files, size_col)
    return c.groupBy("size_class").agg(
        F.count(F.lit(1)).alias("n_files"),
        (F.sum(size_col) / F.lit(float(1024 ** 2))).alias("total_mb"))


def min_content(content: Column, n: int = K.MIN_CONTENT_CHARS) -> Column:
    """Content long enough after stripping."""
    return F.length(text.strip(content)) >= n


def build_documents(files: DataFrame, repo_source_col: str = "repo_source",
                    repo_col: str = "repo", path_col: str = "rel_path",
                    content_col: str = "content", size_col: str = "size_bytes",
                    modified_col: str | None = None, min_chars: int | None = K.MIN_CONTENT_CHARS) -> DataFrame:
    """Documents table rows from kept, decoded files.

    ``doc_id`` is ``md5(repo_id || ':' || rel_path)``: stable under task retry
    and re-ingest. ``file_hash`` is the md5 of the decoded, unstripped text;
    ``content`` is stored stripped.
    """
    c = F.col(content_col)
    rid = paths.repo_id(F.col(repo_source_col))
    df = files
    if min_chars is not None:
        df = df.where(min_content(c, min_chars))
    else:
        df = df.where(F.length(text.strip(c)) > 0)
    stripped = text.strip(c)
    modified = F.col(modified_col) if modified_col else F.lit(None).cast("timestamp")
    return df.select(
        F.md5(F.concat(rid, F.lit(":"), F.col(path_col))).alias("doc_id"),
        rid.alias("repo_id"),
        F.col(repo_col).alias("repo"),
        F.col(repo_source_col).alias("repo_source"),
        F.col(path_col).alias("file_path"),
        text.content_hash(c).alias("file_hash"),
        stripped.alias("content"),
        text.preview(stripped).alias("content_preview"),
        F.struct(paths.doc_type(F.col(path_col)).alias("doc_type"),
                 F.col(size_col).cast("bigint").alias("file_size"),
                 modified.alias("last_modified")).alias("metadata"),
    ).where(F.length(F.col("file_hash")) > 0)


def load_documents(files: DataFrame, policy: str = "ingest", max_bytes: int | str | None = REFERENCE, **kw) -> DataFrame:
    """Policy filter + documents in one lazy plan (``lenient`` keeps any non-blank file)."""
    kept = keep_files(files, policy, max_bytes=max_bytes)
    return build_documents(kept, min_chars=None if policy == "lenient" else K.MIN_CONTENT_CHARS, **kw)
