"""Queries: file policy, size classes, documents, chunks, per-repo totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths, text
from ..operators import chunking, files as fo
from ..operators.catalog import chunk_distribution, repo_totals, read_repo
from ..sources import fixtures as fx
from . import duck as D
from . import duck_chunks
from . import inputs as I
from .registry import query

R = D.q


# --- O25 -----------------------------------------------------------------------

@query("doc_types", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT doc_id, {D.base_name('rel_path')} AS file_name, {D.suffix('rel_path')} AS suffix,
  {D.ext('rel_path')} AS ext, {D.doc_type('rel_path')} AS doc_type FROM fx_files""")
def doc_types(spark, sf):
    p = F.col("rel_path")
    return I.files(spark, sf).select("doc_id", paths.base_name(p).alias("file_name"), paths.suffix(p).alias("suffix"),
                                     paths.ext(p).alias("ext"), paths.doc_type(p).alias("doc_type"))


# --- O10-O14, O21 ----------------------------------------------------------------

@query("file_policy", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT doc_id, {D.policy_reason('ingest')} AS reason, ({D.policy_reason('ingest')}) IS NULL AS keep FROM fx_files""")
def file_policy(spark, sf):
    return fo.apply_policy(I.files(spark, sf), "ingest").select("doc_id", "reason", "keep")


@query("file_policy_counts", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT coalesce({D.policy_reason('ingest')}, 'processable') AS reason, count(*) AS n_files FROM fx_files GROUP BY 1""")
def file_policy_counts(spark, sf):
    return fo.policy_counts(I.files(spark, sf), "ingest")


@query("digest_policy", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT doc_id, {D.policy_reason('digest')} AS reason FROM fx_files""")
def digest_policy(spark, sf):
    """O18: the digest preset of the same rule builder."""
    return fo.apply_policy(I.files(spark, sf), "digest").select("doc_id", "reason")


# --- O26, O27, O82 -----------------------------------------------------------------

def _size_class_sql(s="size_bytes"):
    return (f"CASE WHEN {s} < {K.SIZE_SMALL_MAX} THEN 'small' WHEN {s} < {K.SIZE_MEDIUM_MAX} THEN 'medium' "
            f"WHEN {s} < {K.SIZE_LARGE_MAX} THEN 'large' ELSE 'xlarge' END")


@query("size_classes", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT doc_id, {_size_class_sql()} AS size_class, greatest(1, size_bytes // 2000) AS estimated_chunks,
  round(size_bytes * 3 / 1048576.0, 6) AS memory_mb FROM fx_files""")
def size_classes(spark, sf):
    c = fo.classify_sizes(I.files(spark, sf))
    return c.select("doc_id", "size_class", "estimated_chunks", F.round("memory_mb", 6).alias("memory_mb"))


@query("size_class_union", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT doc_id, size_class, size_bytes FROM (SELECT *, {_size_class_sql()} AS size_class FROM fx_files) WHERE size_class = 'small'
UNION ALL
SELECT doc_id, size_class, size_bytes FROM (SELECT *, {_size_class_sql()} AS size_class FROM fx_files) WHERE size_class = 'medium'""")
def size_class_union(spark, sf):
    """Files of the classes that one path handles together."""
    return fo.of_size_classes(I.files(spark, sf)).select("doc_id", "size_class", "size_bytes")


@query("size_summary", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT {_size_class_sql()} AS size_class, count(*) AS n_files, round(sum(size_bytes) / 1048576.0, 6) AS total_mb
FROM fx_files GROUP BY 1""")
def size_summary(spark, sf):
    s = fo.size_summary(I.files(spark, sf))
    return s.select("size_class", "n_files", F.round("total_mb", 6).alias("total_mb"))


# --- O17 --------------------------------------------------------------------------

@query("min_content", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT doc_id, CAST(length({D.strip('content')}) AS BIGINT) AS stripped_chars,
  length({D.strip('content')}) >= {K.MIN_CONTENT_CHARS} AS passes FROM fx_files""")
def min_content(spark, sf):
    c = F.col("content")
    return I.files(spark, sf).select("doc_id", F.length(text.strip(c)).cast("bigint").alias("stripped_chars"),
                                     fo.min_content(c).alias("passes"))


# --- O06, O19, O28, O29 ---------------------------------------------------------------

@query("documents_table", lambda: D.std_ctes() + """
SELECT doc_id, repo_id, file_path, file_hash, content_preview, doc_type, file_size FROM docs""")
def documents_table(spark, sf):
    d = I.documents(spark, sf)
    return d.select("doc_id", "repo_id", "file_path", "file_hash", "content_preview",
                    F.col("metadata.doc_type").alias("doc_type"), F.col("metadata.file_size").alias("file_size"))


@query("docs_lenient", lambda: D.with_ctes(["fx_files"], [("ld", D.docs_select("fx_files", "lenient"))]) + """
SELECT doc_id, repo_id, file_path, file_hash, doc_type FROM ld""")
def docs_lenient(spark, sf):
    d = I.documents(spark, sf, policy="lenient")
    return d.select("doc_id", "repo_id", "file_path", "file_hash", F.col("metadata.doc_type").alias("doc_type"))


# --- O56, O30, O32, O98, O58 --------------------------------------------------------

@query("chunks_fixed", lambda: D.std_ctes() + """
SELECT chunk_id, doc_id, repo_id, chunk_num, size, chunk_hash, source_file FROM chunks""")
def chunks_fixed(spark, sf):
    c = I.chunks(spark, sf)
    return c.select("chunk_id", "doc_id", "repo_id", F.col("chunk_num").cast("bigint").alias("chunk_num"),
                    F.col("size").cast("bigint").alias("size"), "chunk_hash", "source_file")


@query("chunks_dedup", lambda: D.std_ctes() + """
SELECT chunk_id, doc_id, max(chunk_num) AS chunk_num FROM chunks GROUP BY chunk_id, doc_id""")
def chunks_dedup(spark, sf):
    c = chunking.chunk_fixed(I.documents(spark, sf), dedup=True)
    return c.select("chunk_id", "doc_id", F.col("chunk_num").cast("bigint").alias("chunk_num"))


@query("chunks_recursive", lambda: duck_chunks.statement())
def chunks_recursive(spark, sf):
    """O55: separator-aware chunks (DuckDB: one recursive query over offsets)."""
    c = chunking.chunk(I.documents(spark, sf), mode="recursive")
    return c.select("chunk_id", "doc_id", "repo_id", F.col("chunk_num").cast("bigint").alias("chunk_num"),
                    F.col("size").cast("bigint").alias("size"))


@query("chunks_buffered", lambda: duck_chunks.statement(buffered=True))
def chunks_buffered(spark, sf):
    """O57: buffered chunking of every document, whatever its size."""
    c = chunking.chunk(I.documents(spark, sf), mode="buffered")
    return c.select("chunk_id", "doc_id", F.col("chunk_num").cast("bigint").alias("chunk_num"),
                    F.col("size").cast("bigint").alias("size"))


# --- O55 followed by O58, O81, O84: the tables as separator-aware chunks fill them ----------

@query("chunks_recursive_dedup", lambda: duck_chunks.ctes() + """
SELECT doc_id || ':' || md5(content) AS chunk_id, doc_id, max(chunk_num) AS chunk_num FROM split_chunks GROUP BY 1, 2""")
def chunks_recursive_dedup(spark, sf):
    """The chunks that stay when equal text of a document is stored once."""
    c = chunking.dedup_chunks(chunking.chunk(I.documents(spark, sf), mode="recursive"))
    return c.select("chunk_id", "doc_id", F.col("chunk_num").cast("bigint").alias("chunk_num"))


@query("repo_totals_recursive", lambda: duck_chunks.ctes() + """
SELECT d.repo_id, d.total_files, coalesce(c.total_chunks, 0) AS total_chunks, coalesce(c.chunks_stored, 0) AS chunks_stored
FROM (SELECT repo_id, count(*) AS total_files FROM docs GROUP BY 1) d
LEFT JOIN (SELECT repo_id, count(*) AS total_chunks, count(DISTINCT doc_id || md5(content)) AS chunks_stored FROM split_chunks GROUP BY 1) c
  ON d.repo_id = c.repo_id""")
def repo_totals_recursive(spark, sf):
    d = I.documents(spark, sf)
    return repo_totals(d, chunking.chunk(d, mode="recursive"))


@query("chunk_distribution_recursive", lambda: duck_chunks.ctes() + f"""
SELECT repo_id, source_file, n_chunks, rank FROM (
  SELECT repo_id, source_file, n_chunks,
    CAST(row_number() OVER (PARTITION BY repo_id ORDER BY n_chunks DESC, source_file) AS BIGINT) AS rank
  FROM (SELECT d.repo_id, d.file_path AS source_file, count(*) AS n_chunks FROM split_chunks JOIN docs d USING (doc_id) GROUP BY 1, 2))
WHERE rank <= {K.CHUNK_DISTRIBUTION_TOP}""")
def chunk_distribution_recursive(spark, sf):
    c = chunking.chunk(I.documents(spark, sf), mode="recursive")
    return chunk_distribution(c, by="source_file", n=K.CHUNK_DISTRIBUTION_TOP)


# --- O81, O84 ---------------------------------------------------------------------------

@query("repo_totals", lambda: D.std_ctes() + """
SELECT d.repo_id, d.total_files, coalesce(c.total_chunks, 0) AS total_chunks, coalesce(c.chunks_stored, 0) AS chunks_stored
FROM (SELECT repo_id, count(*) AS total_files FROM docs GROUP BY 1) d
LEFT JOIN (SELECT repo_id, count(*) AS total_chunks, count(DISTINCT chunk_id) AS chunks_stored FROM chunks GROUP BY 1) c
  ON d.repo_id = c.repo_id""")
def repo_totals_q(spark, sf):
    return repo_totals(I.documents(spark, sf), I.chunks(spark, sf))


@query("chunk_distribution", lambda: D.std_ctes() + """
SELECT repo_id, source_file, n_chunks, rank FROM (
  SELECT repo_id, source_file, n_chunks,
    CAST(row_number() OVER (PARTITION BY repo_id ORDER BY n_chunks DESC, source_file) AS BIGINT) AS rank
  FROM (SELECT repo_id, source_file, count(*) AS n_chunks FROM chunks GROUP BY 1, 2))
WHERE rank <= 10""")
def chunk_distribution_q(spark, sf):
    return chunk_distribution(I.chunks(spark, sf), by="source_file", n=K.CHUNK_DISTRIBUTION_TOP)


@query("chunk_distribution_ext", lambda: D.std_ctes() + f"""
SELECT repo_id, ext, n_chunks, rank FROM (
  SELECT repo_id, ext, n_chunks,
    CAST(row_number() OVER (PARTITION BY repo_id ORDER BY n_chunks DESC, ext) AS BIGINT) AS rank
  FROM (SELECT repo_id, CASE WHEN {D.suffix('source_file')} = '' THEN 'no extension' ELSE {D.suffix('source_file')} END AS ext,
        count(*) AS n_chunks FROM chunks GROUP BY 1, 2))
WHERE rank <= 10""")
def chunk_distribution_ext_q(spark, sf):
    return chunk_distribution(I.chunks(spark, sf), by="ext", n=K.CHUNK_DISTRIBUTION_TOP)


# --- O07, O99: table reads for one repository ---------------------------------------------

def _needs_update(spark, sf):
    """Repositories whose digest changed since the stored tables (O70)."""
    from .q_catalog import current_digests, sources, stored_tables
    from ..operators.catalog import repo_changes
    ch = repo_changes(sources(spark, sf), current_digests(spark, sf), stored_tables(spark, sf)["repositories"])
    return ch.where(F.col("action") != "unchanged").select("repo_id")


def _needs_update_sql() -> str:
    from .q_catalog import _ctes
    return _ctes([("todo", "SELECT DISTINCT repo_id FROM changes WHERE action <> 'unchanged'")])


@query("repo_chunks", lambda: _needs_update_sql() + """
SELECT chunk_id, chunk_num, size FROM chunks WHERE repo_id IN (SELECT repo_id FROM todo)""")
def repo_chunks(spark, sf):
    """Chunks of every repository that needs an update, in chunk-id order."""
    c = read_repo(I.chunks(spark, sf), repo_ids=_needs_update(spark, sf), order="chunk_id")
    return c.select("chunk_id", F.col("chunk_num").cast("bigint").alias("chunk_num"), F.col("size").cast("bigint").alias("size"))


@query("repo_documents", lambda: _needs_update_sql() + """
SELECT file_path, content_preview FROM docs WHERE repo_id IN (SELECT repo_id FROM todo)""")
def repo_documents(spark, sf):
    """Documents of every repository that needs an update, in path order."""
    d = read_repo(I.documents(spark, sf), repo_ids=_needs_update(spark, sf), order="file_path")
    return d.select("file_path", "content_preview")


# --- O33 ------------------------------------------------------------------------------------

@query("metadata_path", lambda: D.std_ctes() + """
SELECT chunk_id,
  coalesce(json_extract_string(json_object('source_file', source_file, 'chunk_num', chunk_num, 'repo', repo), '$.source_file'), '') AS path_from_json,
  CASE WHEN json_valid(repr) THEN coalesce(json_extract_string(repr, '$.source_file'), '') ELSE '' END AS path_from_repr
FROM (SELECT *, '{''source_file'': ''' || source_file || ''', ''chunk_num'': ' || CAST(chunk_num AS VARCHAR) || '}' AS repr FROM chunks)""")
def metadata_path(spark, sf):
    """Source path out of chunk metadata text: JSON parses, a Python-repr dict does not."""
    c = I.chunks(spark, sf)
    js = F.to_json(F.struct("source_file", "chunk_num", "repo"))
    repr_ = F.concat(F.lit("{'source_file': '"), F.col("source_file"), F.lit("', 'chunk_num': "), F.col("chunk_num").cast("string"), F.lit("}"))
    return c.select("chunk_id", text.metadata_path(js).alias("path_from_json"), text.metadata_path(repr_).alias("path_from_repr"))


# --- O05, O15, O16: bytes -> sniff -> text ---------------------------------------------------

def _doc_bytes(spark, sf):
    """documents as raw bytes: UTF-8 for most rows, Latin-1 (lossy) for every
    seventh row, with CR LF line ends in every fifth row."""
    d = fx.table(spark, sf, "documents")
    txt = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", "\n", "\r\n")).otherwise(F.col("text"))
    enc = F.when(F.col("doc_id") % 7 == 0, F.encode(txt, "ISO-8859-1")).otherwise(F.encode(txt, "UTF-8"))
    return d.select("doc_id", "text", enc.alias("bytes"))


_BYTES_SQL = """WITH src AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS t FROM documents),
raw AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN unhex(array_to_string(list_transform(regexp_extract_all(t, '(?s).'),
           lambda c: CASE WHEN unicode(c) < 256 THEN printf('%02X', unicode(c)) ELSE '3F' END), ''))
         ELSE encode(t) END AS b FROM src)
"""


@query("decode_text", lambda: _BYTES_SQL + """, txt AS (
  SELECT doc_id, regexp_replace(coalesce(TRY(decode(b)), array_to_string(list_transform(regexp_extract_all(hex(b), '..'),
           lambda h: chr(CAST('0x' || h AS INTEGER))), '')), '\r\n?', chr(10), 'g') AS content FROM raw)
SELECT doc_id, length(content) AS n_chars, md5(content) AS content_md5 FROM txt""")
def decode_text(spark, sf):
    """Bytes decoded as UTF-8, else Latin-1, newlines normalised (never raises)."""
    from ..sources.tree import decode_text as dec
    b = _doc_bytes(spark, sf)
    out = b.select("doc_id", dec(F.col("bytes")).alias("content"))
    return out.select("doc_id", F.length("content").cast("bigint").alias("n_chars"),
                      F.md5("content").alias("content_md5"))


@query("sniff_binary", lambda: _BYTES_SQL + f""", heads AS (
  SELECT doc_id, octet_length(b) AS n_bytes, regexp_extract_all(substring(hex(b), 1, {2 * K.SNIFF_BYTES}), '..') AS head FROM raw)
SELECT doc_id, CASE WHEN n_bytes > {K.INGEST_MAX_BYTES} THEN 'too_large' WHEN n_bytes = 0 THEN 'empty'
  WHEN list_contains(head, '00') THEN 'nul_byte'
  WHEN len(list_filter(head, lambda h: h BETWEEN '20' AND '7E' OR h IN ('09', '0A', '0D'))) / len(head) < 0.9 THEN 'not_text' END AS reason
FROM heads""")
def sniff_binary(spark, sf):
    """NUL byte / printable-ASCII share of the first KB, at the stricter 0.9
    share so the multilingual rows exercise the rule."""
    from ..sources.tree import head
    b = _doc_bytes(spark, sf).select("doc_id", F.col("bytes").alias("content"),
                                     F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"),
                                     F.octet_length("bytes").cast("bigint").alias("size_bytes"))
    b = b.withColumn("head", head(F.col("content")))
    return b.select("doc_id", fo.policy_reason(b, "ingest", head_col="head", min_printable=0.9).alias("reason"))
