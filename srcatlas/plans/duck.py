"""DuckDB building blocks for the oracle statements.

These are independent SQL formulations of the operators (RE2 regexes,
DuckDB list functions), used only to check the Spark results.
"""

from __future__ import annotations

from .. import constants as K
from ..functions.paths import VALID_URL_RE
from ..sources import fixtures as fx

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def base_name(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def suffix(p: str) -> str:
    return f"regexp_extract({base_name(p)}, '^.+(\\.[^.]+)$', 1)"


def ext(p: str) -> str:
    return f"lower(substring({suffix(p)}, 2))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def strip_fast(c: str) -> str:
    from ..functions.text import WHITESPACE_CHARS
    return f"trim({c}, {q(WHITESPACE_CHARS)})"


def repo_id(src: str) -> str:
    return f"('repo_' || substring(md5({src}), 1, 12))"


def doc_type(p: str) -> str:
    return f"CASE WHEN {suffix(p)} = '' THEN 'unknown' ELSE substring({suffix(p)}, 2) END"


def preview(c: str, n: int = K.PREVIEW_CHARS) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '...' ELSE {c} END"


def policy_reason(policy: str = "ingest", p: str = "rel_path", size: str = "size_bytes", sized: bool = True) -> str:
    parts = f"string_split({p}, '/')"
    name = base_name(p)
    if policy == "ingest":
        rules = [
            ("skip_dir", f"list_has_any({parts}, {lst(K.INGEST_SKIP_DIRS)})"),
            ("binary_ext", f"{ext(p)} IN {inlist(K.INGEST_BINARY_EXT)}"),
            ("skip_name", f"lower({name}) IN {inlist([n.lower() for n in K.INGEST_SKIP_NAMES])}"),
            ("dotfile", f"(starts_with({name}, '.') AND substring({suffix(p)}, 2) NOT IN {inlist(K.DOTFILE_ALLOWED_EXT)})"),
            ("too_large", f"{size} > {K.INGEST_MAX_BYTES}"),
            ("empty", f"{size} = 0"),
        ]
    elif policy == "digest":
        rules = [
            ("skip_dir", f"list_has_any({parts}, {lst(K.DIGEST_SKIP_DIRS)})"),
            ("binary_ext", f"{ext(p)} IN {inlist(K.DIGEST_BINARY_EXT)}"),
            ("dotfile", f"starts_with({name}, '.')"),
            *([("too_large", f"{size} > {K.DIGEST_MAX_BYTES}")] if sized else []),
        ]
    else:
        rules = [
            ("binary_ext", f"{ext(p)} IN {inlist(K.LENIENT_BINARY_EXT)}"),
            ("too_large", f"{size} > {K.LENIENT_MAX_BYTES}"),
        ]
    return "CASE " + " ".join(f"WHEN {cond} THEN {q(r)}" for r, cond in rules) + " ELSE NULL END"


def docs_select(src: str, policy: str = "ingest") -> str:
    """Documents (kept, long enough) from a file inventory relation ``src``."""
    min_chars = "> 0" if policy == "lenient" else f">= {K.MIN_CONTENT_CHARS}"
    rid = repo_id("repo_source")
    return f"""SELECT md5({rid} || ':' || rel_path) AS doc_id, {rid} AS repo_id, repo, repo_source,
  rel_path AS file_path, md5(content) AS file_hash, {strip('content')} AS content,
  {preview(strip('content'))} AS content_preview, {doc_type('rel_path')} AS doc_type,
  CAST(size_bytes AS BIGINT) AS file_size
FROM {src}
WHERE ({policy_reason(policy)}) IS NULL AND length({strip('content')}) {min_chars}"""


def chunks_select(docs: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> str:
    stride = size - overlap
    return f"""SELECT doc_id || ':' || md5(ck) AS chunk_id, doc_id, repo_id, md5(ck) AS chunk_hash, ck AS content,
  CAST(length(ck) AS BIGINT) AS size, CAST(k AS BIGINT) AS chunk_num, file_path AS source_file, repo
FROM (SELECT d.*, t.k, substring(d.content, CAST(t.k * {stride} + 1 AS BIGINT), {size}) AS ck
      FROM {docs} d, unnest(generate_series(0, greatest(0, CAST(ceil((length(d.content) - {size}) / {float(stride)}) AS BIGINT)))) AS t(k))
WHERE length(ck) > 0"""


def code_files_select() -> str:
    return """SELECT doc_id, repo, '/data/' || repo AS repo_source, CAST(doc_id AS VARCHAR) AS rel_path,
  CAST(length(content) AS BIGINT) AS size_bytes, content FROM fx_code"""


def with_ctes(fixtures: list[str], extra: list[tuple[str, str]]) -> str:
    """``WITH`` fixture views, then named extra CTEs in order."""
    head = fx.duckdb_cte(*fixtures) if fixtures else ""
    parts = [f"{n} AS ({body})" for n, body in extra]
    if not parts:
        return head
    if head:
        return head.rstrip("\n") + ",\n" + ",\n".join(parts) + "\n"
    return "WITH " + ",\n".join(parts) + "\n"


def std_ctes(*, code: bool = False, stored: bool = False, extra: list[tuple[str, str]] | None = None) -> str:
    """Common CTE set: fx_files, docs, chunks (+ code docs/chunks, stored docs)."""
    fixtures = ["fx_files"] + (["fx_code"] if code else []) + (["fx_stored_files"] if stored else [])
    ctes = [("docs", docs_select("fx_files")), ("chunks", chunks_select("docs"))]
    if code:
        ctes += [("code_files", code_files_select()), ("code_docs", docs_select("code_files")),
                 ("code_chunks", chunks_select("code_docs"))]
    if stored:
        ctes += [("stored_docs", docs_select("fx_stored_files"))]
    return with_ctes(fixtures, ctes + (extra or []))


VALID_URL = VALID_URL_RE
