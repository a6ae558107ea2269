"""Repository catalog: ids, sources, digests, change detection, status,
upserts, deletes, integrity audits and corpus statistics.

Tables (all plain DataFrames):
  repositories(id, source, type, total_files, total_chunks, content_hash, processed_at)
  documents(doc_id, repo_id, file_path, file_hash, content, content_preview, metadata)
  chunks(chunk_id, doc_id, repo_id, chunk_hash, content, size, chunk_num, source_file, repo)

Joins between per-repository frames are keyed on ``repo_id``/``source``;
the per-repository side is one row per repository, so AQE may broadcast it
after measuring it at run time. Nothing here collects to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths
from . import files as fo
from .joins import pruned_semi_join, salted_join


# --- sources --------------------------------------------------------------------

def classify_sources(sources: DataFrame, known_paths: DataFrame | None = None,
                     source_col: str = "source") -> DataFrame:
    """Adds ``kind`` (online | local | rejected), ``reason`` and the
    normalised ``repo_source``. ``known_paths(path)`` lists the paths that
    exist; a local source is kept only when it is listed there."""
    s = F.col(source_col)
    df = sources
    if known_paths is not None:
        kp = known_paths.select(F.col("path").alias("_known")).distinct()
        df = df.join(kp, s == F.col("_known"), "left")
        exists = F.col("_known").isNotNull()
    else:
        exists = F.lit(False)
    gh = F.concat(F.lit("https://"), s)
    kind = (F.when(s.isNull() | (s == ""), F.lit("rejected"))
            .when(s.startswith("http"), F.when(paths.valid_url(s), F.lit("online")).otherwise(F.lit("rejected")))
            .when(s.startswith("github.com"), F.when(paths.valid_url(gh), F.lit("online")).otherwise(F.lit("rejected")))
            .when(s.startswith("www"), F.lit("rejected"))
            .when(exists, F.lit("local"))
            .otherwise(F.lit("rejected")))
    reason = (F.when(s.isNull() | (s == ""), F.lit("blank"))
              .when(s.startswith("http"), F.when(paths.valid_url(s), F.lit(None)).otherwise(F.lit("invalid_url")))
              .when(s.startswith("github.com"), F.when(paths.valid_url(gh), F.lit(None)).otherwise(F.lit("invalid_url")))
              .when(s.startswith("www"), F.lit("www_prefix"))
              .when(exists, F.lit(None))
              .otherwise(F.lit("missing_path")))
    norm = F.when(s.startswith("github.com"), gh).otherwise(s)
    out = df.withColumn("kind", kind).withColumn("reason", reason.cast("string")) \
        .withColumn("repo_source", F.when(F.col("kind") == "rejected", F.lit(None)).otherwise(norm))
    return out.drop("_known") if known_paths is not None else out


def valid_sources(classified: DataFrame) -> DataFrame:
    """(source, type) of the accepted sources, online and local together."""
    return classified.where(F.col("kind") != "rejected") \
        .select(F.col("repo_source").alias("source"), F.col("kind").alias("type"))


def all_sources(online: DataFrame, local: DataFrame) -> DataFrame:
    return online.select("source", "type").unionByName(local.select("source", "type"))


# --- digests --------------------------------------------------------------------

def file_digests(files: DataFrame, content_col: str = "content", max_bytes: int | None = None) -> DataFrame:
    """(repo_source, rel_path, entry) of the files the digest policy keeps;
    ``entry`` is the md5 of the path and of the file's bytes (or text)."""
    kept = fo.keep_files(files, "digest", max_bytes=max_bytes)
    return kept.select(
        F.col("repo_source"), F.col("rel_path"),
        F.md5(F.concat(F.col("rel_path"), F.lit(":"), F.md5(F.col(content_col)))).alias("entry"))


def repo_digest(files: DataFrame, content_col: str = "content", max_bytes: int | None = None) -> DataFrame:
    """repo_source -> (repo_id, content_hash, n_files).

    A repository's digest is the md5 of the sums of its files' entries, taken
    as four 32-bit numbers each. Sums do not depend on order and add up in
    every task before the shuffle, so one row for each task and repository
    moves, however many files it has. Any changed, added, removed or renamed
    file changes the sums. Pass the raw bytes as ``content_col`` to see
    changes of encoding and line ends too."""
    fd = file_digests(files, content_col, max_bytes)
    word = lambda i: F.conv(F.substring("entry", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = fd.groupBy("repo_source").agg(
        *[F.sum(word(i)).alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).cast("bigint").alias("n_files"))
    text = F.concat_ws(":", *[F.col(f"s{i}").cast("string") for i in range(4)], F.col("n_files").cast("string"))
    return sums.select("repo_source", paths.repo_id("repo_source").alias("repo_id"), F.md5(text).alias("content_hash"), "n_files")


# --- tables -----------------------------------------------------------------------

def repo_totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files and chunks per repository: chunks emitted and chunks stored
    (distinct chunk ids, i.e. after the replace-on-key collapse)."""
    d = documents.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
    c = chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_chunks"),
                                      F.count_distinct("chunk_id").alias("chunks_stored"))
    return d.join(c, "repo_id", "left").select(
        "repo_id", "total_files",
        F.coalesce("total_chunks", F.lit(0)).cast("bigint").alias("total_chunks"),
        F.coalesce("chunks_stored", F.lit(0)).cast("bigint").alias("chunks_stored"))


def build_repositories(documents: DataFrame, chunks: DataFrame, digests: DataFrame,
                       processed_at: Column, type_: str = "local") -> DataFrame:
    """repositories rows from ingested tables and digests. ``processed_at``
    is the caller's expression over the row (``id``, totals, digest), never
    the wall clock, so a re-run gives the same table."""
    tot = repo_totals(documents, chunks)
    src = documents.select("repo_id", F.col("repo_source").alias("source")).distinct()
    rep = src.join(tot, "repo_id").join(digests.select("repo_id", "content_hash"), "repo_id", "left")
    rows = rep.select(F.col("repo_id").alias("id"), "source", F.lit(type_).alias("type"),
                      F.col("total_files").cast("bigint").alias("total_files"),
                      F.col("total_chunks").cast("bigint").alias("total_chunks"), "content_hash")
    return rows.withColumn("processed_at", processed_at)


def read_repo(table: DataFrame, sources: list[str] | None = None, repo_ids: list[str] | DataFrame | None = None,
              order: str | None = None) -> DataFrame:
    """Rows of the given repositories, ordered by ``order`` when given.

    ``repo_ids`` may be a short literal list (a partition filter on a table
    stored partitioned by ``repo_id``) or a DataFrame of ids computed by
    another job: a left-semi join whose rows are dealt out. For a stored table
    see ``read_table``, which reads the partitions of the ids only."""
    if isinstance(repo_ids, DataFrame):
        out = salted_join(table, repo_ids.select("repo_id").distinct(), ["repo_id"], "left_semi", _row_key(table))
    else:
        ids = list(repo_ids or []) + [_repo_id_str(s) for s in (sources or [])]
        out = table.where(F.col("repo_id").isin(*ids)) if ids else table.limit(0)
    return out.orderBy(order) if order else out


def _row_key(table: DataFrame) -> list[str]:
    """Columns that tell a table's rows apart, as far as it has them."""
    return [c for c in ("chunk_id", "doc_id", "rel_path") if c in table.columns] or table.columns[:1]


def read_table(spark, path: str, repo_ids: list[str] | DataFrame | None = None, order: str | None = None,
               schema=None) -> DataFrame:
    """A stored table (parquet partitioned by ``repo_id``); with ``repo_ids``
    only those partitions are read: a literal list prunes when the query is
    planned, a stored DataFrame of ids when it runs. ``schema`` saves reading
    a file's footer for it."""
    t = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    if isinstance(repo_ids, DataFrame):
        t = pruned_semi_join(t, repo_ids)
    elif repo_ids:
        t = t.where(F.col("repo_id").isin(*repo_ids))
    return t.orderBy(order) if order else t


def repos_by_recency(repositories: DataFrame) -> DataFrame:
    """(position, id, source, processed_at) of every repository, the latest
    processed first, ties by id.

    No task sorts the whole table: rows are counted by day, within a day by
    time and beginning of the id, and ordered within those only; a position is
    the sum of the counts before."""
    first = F.to_timestamp(F.lit("0001-01-01 00:00:00"))  # without a time: after all others
    r = repositories.select("id", "source", "processed_at").withColumn("_t", F.coalesce("processed_at", first)).withColumn(
        "_day", F.to_date("_t")).withColumn("_begin", F.substring("id", 1, len("repo_") + 2))
    bucket = ["_day", "_t", "_begin"]
    n = F.count(F.lit(1)).alias("_n")
    earlier = lambda w: F.sum("_n").over(w) - F.col("_n")
    in_day = r.groupBy(*bucket).agg(n).select(*bucket, earlier(Window.partitionBy("_day").orderBy(F.desc("_t"), "_begin")).alias("_in_day"))
    days = r.groupBy("_day").agg(n).select("_day", earlier(Window.orderBy(F.desc("_day"))).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy("id"))
    return r.withColumn("_at", place).join(in_day, bucket).join(days, "_day").select(
        (F.col("_before") + F.col("_in_day") + F.col("_at")).cast("bigint").alias("position"), "id", "source", "processed_at")


def _repo_id_str(source: str) -> str:
    import hashlib
    return "repo_" + hashlib.md5(source.encode("utf-8")).hexdigest()[:12]


def chunk_distribution(chunks: DataFrame, by: str = "source_file", n: int = K.CHUNK_DISTRIBUTION_TOP) -> DataFrame:
    """Top ``n`` files (or extensions) per repository by chunk count.

    The row_number filter has a constant limit, so Spark inserts a
    per-partition group limit before the shuffle: each map task sends at
    most ``n`` rows per repository."""
    if by == "ext":
        s = paths.suffix("source_file")
        key = F.when(s == "", F.lit("no extension")).otherwise(s).alias("ext")
        kname = "ext"
    else:
        key = F.col(by)
        kname = by
    counts = chunks.groupBy("repo_id", key).agg(F.count(F.lit(1)).alias("n_chunks"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n_chunks"), F.asc(kname))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select("repo_id", kname, "n_chunks", F.col("rank").cast("bigint").alias("rank"))


# --- change detection and status ----------------------------------------------------

def repo_changes(sources: DataFrame, current: DataFrame, repositories: DataFrame) -> DataFrame:
    """sources(source, type) + current digests(repo_source, content_hash) +
    stored repositories -> action per source:
    ``update_online`` | ``update_no_digest`` | ``changed`` | ``unchanged``."""
    cur = current.select(F.col("repo_source").alias("source"), F.col("content_hash").alias("current_hash"))
    stored = repositories.select(F.col("id").alias("repo_id"), F.col("content_hash").alias("stored_hash"))
    df = sources.withColumn("repo_id", paths.repo_id("source")) \
        .join(cur, "source", "left").join(stored, "repo_id", "left")
    online = F.col("source").startswith("http://") | F.col("source").startswith("https://")
    action = (F.when(online, F.lit("update_online"))
              .when(F.coalesce(F.col("current_hash"), F.lit("")) == "", F.lit("update_no_digest"))
              .when(~F.col("stored_hash").eqNullSafe(F.col("current_hash")), F.lit("changed"))
              .otherwise(F.lit("unchanged")))
    return df.withColumn("action", action)


def existing_sources(sources: DataFrame, repositories: DataFrame) -> DataFrame:
    return sources.join(repositories.select("source"), "source", "left_semi")


def missing_repos(sources: DataFrame, present: DataFrame) -> DataFrame:
    """Sources whose repository name is not among the present names
    (``present(name)``)."""
    names = present.select(F.col("name").alias("_name")).distinct()
    s = sources.withColumn("repo_name", paths.repo_name("source"))
    return s.join(names, F.col("repo_name") == F.col("_name"), "left_anti")


def repo_status(sources: DataFrame, current: DataFrame, repositories: DataFrame) -> DataFrame:
    ch = repo_changes(sources, current, repositories)
    ids = repositories.select(F.col("id").alias("repo_id"), F.lit(True).alias("_exists"))
    return ch.join(ids, "repo_id", "left").select(
        "source", "type", "repo_id", "current_hash", "stored_hash",
        F.col("stored_hash").isNotNull().alias("has_stored_hash"),
        F.coalesce("_exists", F.lit(False)).alias("exists_in_db"),
        (F.col("action") != "unchanged").alias("needs_update"))


def status_totals(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("type") == "online").alias("online"),
        F.count_if(F.col("type") == "local").alias("local"),
        F.count_if("has_stored_hash").alias("has_stored_hash"),
        F.count_if("exists_in_db").alias("exists_in_db"),
        F.count_if("needs_update").alias("needs_update"))


# --- writes: upsert, update, delete ---------------------------------------------------

def dedup_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (an aggregate:
    duplicates collapse map-side)."""
    others = [c for c in df.columns if c not in key]
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in others])).alias("_b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in others]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """INSERT OR REPLACE on ``key``: new rows win, old rows without a new
    row stay. Of several new rows with one key the greatest by ``order`` wins
    (without ``order``: the greatest by its other columns)."""
    others = [c for c in new.columns if c not in key]
    fresh = dedup_last(new, key, order or others[0]) if others else new.dropDuplicates(key)
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh.select(*old.columns))


def update_digests(repositories: DataFrame, digests: DataFrame, processed_at: Column) -> DataFrame:
    """Set ``content_hash`` (and ``processed_at``) for the repositories in
    ``digests(repo_id, content_hash)``; others keep their row."""
    d = digests.select(F.col("repo_id").alias("id"), F.col("content_hash").alias("_new"), F.lit(True).alias("_hit"))
    r = repositories.join(d, "id", "left")
    return r.select(
        "id", "source", "type", "total_files", "total_chunks",
        F.coalesce("_new", "content_hash").alias("content_hash"),
        F.when(F.col("_hit"), processed_at).otherwise(F.col("processed_at")).alias("processed_at"))


def delete_repos(tables: dict[str, DataFrame], repo_ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove the rows of ``repo_ids(repo_id)`` from every table. Returns the
    remaining tables and (table_name, n_deleted)."""
    keys = repo_ids.select("repo_id").distinct()
    kept, counts = {}, None
    for name, t in tables.items():
        col = "id" if name == "repositories" else "repo_id"
        k = keys.withColumnRenamed("repo_id", col)
        kept[name] = salted_join(t, k, [col], "left_anti", _row_key(t)).select(*t.columns)
        # counted by id before the join: a repository moves one row for each task
        n = t.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).join(k, col, "left_semi") \
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_deleted")) \
            .select(F.lit(name).alias("table_name"), "n_deleted")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def fk_orphans(documents: DataFrame, chunks: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rows whose declared parent is missing: (check, n_orphans)."""
    repos = repositories.select(F.col("id").alias("repo_id")).distinct()
    docs = documents.select("doc_id").distinct()

    def missing(table: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        # rows of one parent are counted before the join, so a parent moves
        # one row for each task however many rows name it
        named = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return named.join(parents, key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_orphans"))

    checks = [(documents, repos, "repo_id", "documents.repo_id"), (chunks, docs, "doc_id", "chunks.doc_id"),
              (chunks, repos, "repo_id", "chunks.repo_id")]
    out = None
    for table, parents, key, name in checks:
        n = missing(table, parents, key).select(F.lit(name).alias("check"), "n_orphans")
        out = n if out is None else out.unionByName(n)
    return out


# --- statistics ---------------------------------------------------------------------------

def corpus_stats(repositories: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: counts of repositories, documents, chunks and vectors.
    One aggregate over the tagged union of the four tables (each task
    counts its rows, then one tiny merge)."""
    tagged = repositories.select(F.lit(0).alias("t")).unionByName(documents.select(F.lit(1).alias("t"))) \
        .unionByName(chunks.select(F.lit(2).alias("t"))).unionByName(vectors.select(F.lit(3).alias("t")))
    return tagged.agg(*[F.count_if(F.col("t") == i).cast("bigint").alias(n) for i, n in enumerate(
        ["total_repositories", "total_documents", "total_chunks", "total_vectors"])])


def recent_repos(repositories: DataFrame, n: int = K.RECENT_REPOS) -> DataFrame:
    """The ``n`` most recently processed repositories (top-k, no full sort)."""
    return repositories.orderBy(F.desc("processed_at"), F.asc("id")).limit(n)
