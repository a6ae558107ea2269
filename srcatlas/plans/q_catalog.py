"""Queries: sources, digests, change detection, status, upsert/delete, stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths
from ..operators import catalog as cat
from ..operators import chunking, files as fo
from ..operators import vectors as vec
from ..sources import fixtures as fx
from . import duck as D
from . import inputs as I
from .registry import query

R = D.q


# --- Spark-side inputs ---------------------------------------------------------

#: Fixture times: a day of 2025 that follows from the repository's id and
#: not from its size.
PROCESSED_SQL = "make_timestamp((1735689600 + (('0x' || substring(md5(d.repo_id), 1, 6))::BIGINT)) * 1000000)"


def processed_at():
    return F.timestamp_seconds(F.lit(1735689600) + F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("bigint"))


def classified(spark, sf):
    known = I.files(spark, sf).select(F.col("repo_source").alias("path"))
    return cat.classify_sources(fx.view(spark, sf, "fx_sources"), known)


def sources(spark, sf):
    return cat.valid_sources(classified(spark, sf)).distinct()


def current_digests(spark, sf):
    return cat.repo_digest(I.files(spark, sf))


def stored_tables(spark, sf):
    """Yesterday's tables, ingested from fx_stored_files."""
    docs = fo.load_documents(I.stored_files(spark, sf))
    chunks = chunking.chunk_fixed(docs)
    repos = cat.build_repositories(docs, chunks, cat.repo_digest(I.stored_files(spark, sf)), processed_at())
    return {"repositories": repos, "documents": docs, "chunks": chunks}


def current_tables(spark, sf):
    docs = I.documents(spark, sf)
    chunks = chunking.chunk_fixed(docs)
    repos = cat.build_repositories(docs, chunks, current_digests(spark, sf), processed_at())
    return {"repositories": repos, "documents": docs, "chunks": chunks}


# --- DuckDB-side CTEs --------------------------------------------------------------

def _classify_sql(src="fx_sources"):
    v = D.VALID_URL
    s = "source"
    gh = "('https://' || source)"
    return f"""SELECT source_id, source,
  CASE WHEN {s} IS NULL OR {s} = '' THEN 'rejected'
       WHEN starts_with({s}, 'http') THEN CASE WHEN regexp_matches({s}, {R(v)}) THEN 'online' ELSE 'rejected' END
       WHEN starts_with({s}, 'github.com') THEN CASE WHEN regexp_matches({gh}, {R(v)}) THEN 'online' ELSE 'rejected' END
       WHEN starts_with({s}, 'www') THEN 'rejected'
       WHEN {s} IN (SELECT repo_source FROM fx_files) THEN 'local' ELSE 'rejected' END AS kind,
  CASE WHEN {s} IS NULL OR {s} = '' THEN 'blank'
       WHEN starts_with({s}, 'http') THEN CASE WHEN regexp_matches({s}, {R(v)}) THEN NULL ELSE 'invalid_url' END
       WHEN starts_with({s}, 'github.com') THEN CASE WHEN regexp_matches({gh}, {R(v)}) THEN NULL ELSE 'invalid_url' END
       WHEN starts_with({s}, 'www') THEN 'www_prefix'
       WHEN {s} IN (SELECT repo_source FROM fx_files) THEN NULL ELSE 'missing_path' END AS reason
FROM {src}"""


def _classified_sql():
    return f"""SELECT source_id, source, kind, reason,
  CASE WHEN kind = 'rejected' THEN NULL WHEN starts_with(source, 'github.com') THEN 'https://' || source ELSE source END AS repo_source
FROM ({_classify_sql()})"""


def _digest_sql(src):
    word = lambda i: f"sum(('0x' || substring(entry, {8 * i + 1}, 8))::BIGINT)"
    sums = " || ':' || ".join(f"CAST({word(i)} AS VARCHAR)" for i in range(4))
    return f"""SELECT repo_source, {D.repo_id('repo_source')} AS repo_id,
  md5({sums} || ':' || CAST(count(*) AS VARCHAR)) AS content_hash, count(*) AS n_files
FROM (SELECT repo_source, md5(rel_path || ':' || md5(content)) AS entry
      FROM {src} WHERE ({D.policy_reason('digest', sized=False)}) IS NULL)
GROUP BY repo_source"""


def _repos_sql(docs, chunks, digests):
    return f"""SELECT d.repo_id AS id, d.source, 'local' AS type, d.total_files, coalesce(c.total_chunks, 0) AS total_chunks,
  g.content_hash, {PROCESSED_SQL} AS processed_at
FROM (SELECT repo_id, any_value(repo_source) AS source, count(*) AS total_files FROM {docs} GROUP BY 1) d
LEFT JOIN (SELECT repo_id, count(*) AS total_chunks FROM {chunks} GROUP BY 1) c ON d.repo_id = c.repo_id
LEFT JOIN {digests} g ON g.repo_id = d.repo_id"""


def catalog_ctes(extra=None):
    ctes = [
        ("classified", _classified_sql()),
        ("srcs", "SELECT DISTINCT repo_source AS source, kind AS type FROM classified WHERE kind <> 'rejected'"),
        ("cur_digest", _digest_sql("fx_files")),
        ("stored_digest", _digest_sql("fx_stored_files")),
        ("stored_chunks", D.chunks_select("stored_docs")),
        ("stored_repos", _repos_sql("stored_docs", "stored_chunks", "stored_digest")),
        ("cur_repos", _repos_sql("docs", "chunks", "cur_digest")),
        ("changes", f"""SELECT s.source, s.type, {D.repo_id('s.source')} AS repo_id, c.content_hash AS current_hash,
  r.content_hash AS stored_hash,
  CASE WHEN starts_with(s.source, 'http://') OR starts_with(s.source, 'https://') THEN 'update_online'
       WHEN coalesce(c.content_hash, '') = '' THEN 'update_no_digest'
       WHEN r.content_hash IS DISTINCT FROM c.content_hash THEN 'changed' ELSE 'unchanged' END AS action
FROM srcs s LEFT JOIN cur_digest c ON c.repo_source = s.source LEFT JOIN stored_repos r ON r.id = {D.repo_id('s.source')}"""),
    ]
    return D.std_ctes(stored=True, extra=ctes + (extra or []))


# Fixture views need fx_sources too.
def _ctes(extra=None):
    head = catalog_ctes(extra)
    return head.replace("WITH fx_files AS", "WITH fx_sources AS (" + fx.FX_SOURCES.replace("{pages}", "pages").strip() + "),\nfx_files AS", 1)


# --- O01, O02, O03, O105 ------------------------------------------------------------------

@query("classify_sources", lambda: _ctes() + "SELECT source_id, kind, reason, repo_source FROM classified")
def classify_sources_q(spark, sf):
    return classified(spark, sf).select("source_id", "kind", "reason", "repo_source")


@query("repo_names", lambda: D.with_ctes(["fx_sources"], []) + f"""
SELECT source_id, coalesce(regexp_replace(coalesce(list_filter(string_split(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(source, '^[A-Za-z][A-Za-z0-9+.\\-]*:', ''), '^//[^/?#]*', ''), '[?#].*$', ''), ';[^/]*$', ''),
  '/'), lambda p: p <> '' AND p <> '.')[-1], ''), '\\.git$', ''), '') AS repo_name FROM fx_sources""")
def repo_names(spark, sf):
    s = fx.view(spark, sf, "fx_sources")
    return s.select("source_id", F.coalesce(paths.repo_name("source"), F.lit("")).alias("repo_name"))


@query("repo_ids", lambda: D.with_ctes(["fx_files"], []) + f"""
SELECT DISTINCT repo_source, {D.repo_id('repo_source')} AS repo_id FROM fx_files""")
def repo_ids(spark, sf):
    return I.files(spark, sf).select("repo_source", paths.repo_id("repo_source").alias("repo_id")).distinct()


@query("all_sources", lambda: _ctes() + """
SELECT source, type FROM srcs WHERE type = 'online' UNION ALL SELECT source, type FROM srcs WHERE type = 'local'""")
def all_sources_q(spark, sf):
    s = sources(spark, sf)
    return cat.all_sources(s.where(F.col("type") == "online"), s.where(F.col("type") == "local"))


# --- O83 -----------------------------------------------------------------------------------

@query("repo_digest", lambda: D.with_ctes(["fx_files"], [("g", _digest_sql("fx_files"))]) + "SELECT * FROM g")
def repo_digest_q(spark, sf):
    return current_digests(spark, sf)


# --- O70-O73 ---------------------------------------------------------------------------------

@query("repo_changes", lambda: _ctes() + "SELECT source, type, repo_id, current_hash, stored_hash, action FROM changes")
def repo_changes_q(spark, sf):
    ch = cat.repo_changes(sources(spark, sf), current_digests(spark, sf), stored_tables(spark, sf)["repositories"])
    return ch.select("source", "type", "repo_id", "current_hash", "stored_hash", "action")


@query("existing_sources", lambda: _ctes() + "SELECT source, type FROM srcs WHERE source IN (SELECT source FROM stored_repos)")
def existing_sources_q(spark, sf):
    return cat.existing_sources(sources(spark, sf), stored_tables(spark, sf)["repositories"])


def _repo_name_sql(col):
    return (f"regexp_replace(coalesce(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({col}, "
            f"'^[A-Za-z][A-Za-z0-9+.\\-]*:', ''), '^//[^/?#]*', ''), '[?#].*$', ''), ';[^/]*$', ''), '/'), "
            f"lambda p: p <> '' AND p <> '.')[-1], ''), '\\.git$', '')")


@query("missing_repos", lambda: _ctes() + f"""
SELECT source, type, {_repo_name_sql('source')} AS repo_name FROM srcs
WHERE {_repo_name_sql('source')} NOT IN (SELECT {_repo_name_sql('source')} FROM stored_repos)""")
def missing_repos_q(spark, sf):
    present = stored_tables(spark, sf)["repositories"].select(paths.repo_name("source").alias("name"))
    return cat.missing_repos(sources(spark, sf), present).select("source", "type", "repo_name")


@query("repo_status", lambda: _ctes() + """
SELECT c.source, c.type, c.repo_id, c.current_hash, c.stored_hash, c.stored_hash IS NOT NULL AS has_stored_hash,
  c.repo_id IN (SELECT id FROM stored_repos) AS exists_in_db, c.action <> 'unchanged' AS needs_update
FROM changes c""")
def repo_status_q(spark, sf):
    return cat.repo_status(sources(spark, sf), current_digests(spark, sf), stored_tables(spark, sf)["repositories"])


@query("repo_status_totals", lambda: _ctes() + """
SELECT count(*) AS total, CAST(count_if(type = 'online') AS BIGINT) AS online, CAST(count_if(type = 'local') AS BIGINT) AS local,
  CAST(count_if(stored_hash IS NOT NULL) AS BIGINT) AS has_stored_hash,
  CAST(count_if(repo_id IN (SELECT id FROM stored_repos)) AS BIGINT) AS exists_in_db,
  CAST(count_if(action <> 'unchanged') AS BIGINT) AS needs_update FROM changes""")
def repo_status_totals_q(spark, sf):
    return cat.status_totals(repo_status_q(spark, sf))


# --- O75, O76, O107, O108, O125 ----------------------------------------------------------------

def _to_delete(spark, sf):
    ch = cat.repo_changes(sources(spark, sf), current_digests(spark, sf), stored_tables(spark, sf)["repositories"])
    return ch.where(F.col("action") != "unchanged").select("repo_id")


@query("delete_repos", lambda: _ctes([("del", "SELECT DISTINCT repo_id FROM changes WHERE action <> 'unchanged'")]) + """
SELECT 'repositories' AS table_name, count(*) AS n_deleted FROM stored_repos WHERE id IN (SELECT repo_id FROM del)
UNION ALL SELECT 'documents', count(*) FROM stored_docs WHERE repo_id IN (SELECT repo_id FROM del)
UNION ALL SELECT 'chunks', count(*) FROM stored_chunks WHERE repo_id IN (SELECT repo_id FROM del)""")
def delete_repos_q(spark, sf):
    _, counts = cat.delete_repos(stored_tables(spark, sf), _to_delete(spark, sf))
    return counts


@query("fk_orphans", lambda: _ctes() + """
SELECT 'documents.repo_id' AS "check", count(*) AS n_orphans FROM docs WHERE repo_id NOT IN (SELECT id FROM stored_repos)
UNION ALL SELECT 'chunks.doc_id', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM docs)
UNION ALL SELECT 'chunks.repo_id', count(*) FROM chunks WHERE repo_id NOT IN (SELECT id FROM stored_repos)""")
def fk_orphans_q(spark, sf):
    """Today's documents and chunks audited against yesterday's repositories
    (rows written before their parent row shows up as orphans)."""
    st = stored_tables(spark, sf)
    return cat.fk_orphans(I.documents(spark, sf), I.chunks(spark, sf).select("doc_id", "repo_id"),
                          st["repositories"])


@query("upsert_repos", lambda: _ctes() + """
SELECT id, source, total_files, total_chunks, content_hash FROM stored_repos WHERE id NOT IN (SELECT id FROM cur_repos WHERE id IN (SELECT repo_id FROM changes WHERE action <> 'unchanged'))
UNION ALL SELECT id, source, total_files, total_chunks, content_hash FROM cur_repos WHERE id IN (SELECT repo_id FROM changes WHERE action <> 'unchanged')""")
def upsert_repos_q(spark, sf):
    """Changed repositories' fresh rows replace the stored ones."""
    cur = current_tables(spark, sf)["repositories"]
    changed = cur.join(_to_delete(spark, sf).withColumnRenamed("repo_id", "id"), "id", "left_semi")
    out = cat.upsert(stored_tables(spark, sf)["repositories"], changed, ["id"], order="processed_at")
    return out.select("id", "source", "total_files", "total_chunks", "content_hash")


@query("update_digests", lambda: _ctes() + """
SELECT r.id, coalesce(g.content_hash, r.content_hash) AS content_hash,
  strftime(CASE WHEN g.repo_id IS NOT NULL THEN TIMESTAMP '2026-01-01 00:00:00' ELSE r.processed_at END, '%Y-%m-%d %H:%M:%S') AS processed_at
FROM stored_repos r LEFT JOIN (SELECT * FROM cur_digest WHERE repo_id IN (SELECT repo_id FROM changes WHERE action = 'changed')) g ON g.repo_id = r.id""")
def update_digests_q(spark, sf):
    ch = cat.repo_changes(sources(spark, sf), current_digests(spark, sf), stored_tables(spark, sf)["repositories"])
    new = ch.where(F.col("action") == "changed").select("repo_id", F.col("current_hash").alias("content_hash"))
    out = cat.update_digests(stored_tables(spark, sf)["repositories"], new, F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return out.select("id", "content_hash", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"))


@query("incremental_plan", lambda: _ctes([
    ("del", "SELECT DISTINCT repo_id FROM changes WHERE action <> 'unchanged'"),
    ("final_docs", "SELECT repo_id, doc_id FROM stored_docs WHERE repo_id NOT IN (SELECT repo_id FROM del) "
                   "UNION ALL SELECT repo_id, doc_id FROM docs WHERE repo_id IN (SELECT repo_id FROM del)"),
    ("final_chunks", "SELECT repo_id FROM stored_chunks WHERE repo_id NOT IN (SELECT repo_id FROM del) "
                     "UNION ALL SELECT repo_id FROM chunks WHERE repo_id IN (SELECT repo_id FROM del)"),
]) + """
SELECT d.repo_id, d.total_files, c.total_chunks, CASE WHEN d.repo_id IN (SELECT repo_id FROM del) THEN 'rebuilt' ELSE 'kept' END AS action
FROM (SELECT repo_id, count(*) AS total_files FROM final_docs GROUP BY 1) d
JOIN (SELECT repo_id, count(*) AS total_chunks FROM final_chunks GROUP BY 1) c ON c.repo_id = d.repo_id""")
def incremental_plan_q(spark, sf):
    """O125: changed repositories are deleted and rebuilt from today's
    files; unchanged ones keep yesterday's rows."""
    from ..streaming.ingest import refresh
    tables, rebuilt = refresh(stored_tables(spark, sf), I.files(spark, sf), _to_delete(spark, sf), processed_at())
    d = tables["documents"].groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
    c = tables["chunks"].groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    flag = rebuilt.select("repo_id", F.lit("rebuilt").alias("_a"))
    return d.join(c, "repo_id").join(flag, "repo_id", "left").select(
        "repo_id", "total_files", "total_chunks", F.coalesce("_a", F.lit("kept")).alias("action"))


# --- O80, O97 ---------------------------------------------------------------------------------

@query("corpus_stats", lambda: _ctes() + f"""
SELECT (SELECT count(*) FROM cur_repos) AS total_repositories, (SELECT count(*) FROM docs) AS total_documents,
  (SELECT count(*) FROM chunks) AS total_chunks,
  (SELECT count(*) FROM embeddings WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))) AS total_vectors""")
def corpus_stats_q(spark, sf):
    t = current_tables(spark, sf)
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = vec.valid_vectors(emb.withColumnRenamed("embedding", "vector"), 64)
    return cat.corpus_stats(t["repositories"], t["documents"], t["chunks"], vectors)


@query("repos_by_recency", lambda: _ctes() + """
SELECT row_number() OVER (ORDER BY processed_at DESC NULLS LAST, id) AS position, id, source,
  strftime(processed_at, '%Y-%m-%d %H:%M:%S') AS processed_at FROM cur_repos""")
def repos_by_recency_q(spark, sf):
    """Every repository with its place by time of processing."""
    r = cat.repos_by_recency(current_tables(spark, sf)["repositories"])
    return r.select("position", "id", "source", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"))


@query("recent_repos", lambda: _ctes() + """
SELECT id, source, total_chunks, strftime(processed_at, '%Y-%m-%d %H:%M:%S') AS processed_at
FROM cur_repos ORDER BY processed_at DESC, id LIMIT 5""")
def recent_repos_q(spark, sf):
    r = cat.recent_repos(current_tables(spark, sf)["repositories"], K.RECENT_REPOS)
    return r.select("id", "source", "total_chunks", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"))
