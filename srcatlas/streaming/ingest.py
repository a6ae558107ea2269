"""Incremental ingest: only touched repositories are deleted and rebuilt.

``refresh`` is the batch form (one lazy plan). ``ingest_stream`` reads a
stream of file events and treats each micro-batch as the list of repositories
that it touches: each of those is rebuilt from its inventory, the stored
latest event of each of its files, so a repository whose files come in several
batches, a removed file and a replayed batch all end in the same tables as one
batch of everything. Tables are Parquet, partitioned by repository; a rebuilt
repository replaces its partition, and one without files loses it.

What a batch reads is the batch and the partitions of the repositories it
touches, whatever was streamed before: earlier events are never read again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from ..functions import paths
from ..operators import catalog as cat
from ..operators import chunking, files as fo
from ..operators.joins import pruned_semi_join, salted_join
from ..session import drop_path, path_exists, scratch_table

#: Partition column of each stored table.
TABLES = {"repositories": "id", "documents": "repo_id", "chunks": "repo_id", "vectors": "repo_id", "inventory": "repo_id"}
#: Deletes of partitions at a time.
DELETES = 16


def rebuilt(files: DataFrame, processed_at: Column, chunk_mode: str = "fixed") -> dict[str, DataFrame]:
    """The tables of the repositories in ``files``. The digest is taken over
    every listed file, also those that become no document."""
    docs = fo.load_documents(files)
    chunks = chunking.chunk(docs, mode=chunk_mode)
    repos = cat.build_repositories(docs, chunks, cat.repo_digest(files), processed_at)
    return {"repositories": repos, "documents": docs, "chunks": chunks}


def _of(files: DataFrame, ids: DataFrame) -> DataFrame:
    """The files of the given repositories; a repository may hold a third of
    all files, so its rows are dealt out for the join."""
    f = files.withColumn("repo_id", paths.repo_id("repo_source"))
    return salted_join(f, ids, ["repo_id"], "left_semi", "rel_path").drop("repo_id")


def refresh(tables: dict[str, DataFrame], files: DataFrame, to_rebuild: DataFrame, processed_at: Column,
            chunk_mode: str = "fixed") -> tuple[dict[str, DataFrame], DataFrame]:
    """tables(repositories, documents, chunks) + today's files + repo ids to
    rebuild -> new tables, and the rebuilt repo ids."""
    ids = to_rebuild.select("repo_id").distinct()
    kept, _ = cat.delete_repos(tables, ids)
    f = _of(files, ids)
    new = rebuilt(f, processed_at, chunk_mode)
    out = {name: kept[name].unionByName(new[name].select(*kept[name].columns)) for name in kept}
    return out, ids


# --- stored tables ----------------------------------------------------------

def write_table(df: DataFrame, path: str, partition_col: str | list[str] = "repo_id", mode: str = "overwrite") -> None:
    """Parquet sink, partitioned by repository; only the partitions present
    in ``df`` are replaced."""
    cols = [partition_col] if isinstance(partition_col, str) else partition_col
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*cols).parquet(path))


def drop_partitions(spark: SparkSession, path: str, partitions: DataFrame) -> None:
    """Remove the partitions that the rows of ``partitions`` name, one column
    for each level, ``DELETES`` at a time."""
    def drop(row) -> bool:
        return drop_path(spark, "/".join([path, *[f"{c}={row[c]}" for c in partitions.columns]]))

    with ThreadPoolExecutor(DELETES) as pool:
        waiting = []
        for row in partitions.toLocalIterator():
            waiting.append(pool.submit(drop, row))
            if len(waiting) >= 64 * DELETES:
                waiting.pop(0).result()
        for w in waiting:
            w.result()


def delete_stored(spark: SparkSession, out_dir: str, repo_ids: DataFrame, tables: list[str] | None = None) -> None:
    """Delete repositories from the stored tables, vectors and the inventory
    included."""
    ids = repo_ids.select("repo_id").distinct()
    for name in tables or TABLES:
        drop_partitions(spark, f"{out_dir}/{name}", ids.select(F.col("repo_id").alias(TABLES[name])))


def drop_stale_vectors(spark: SparkSession, out_dir: str, repo_ids: DataFrame) -> None:
    """Remove the stored vectors of the given repositories whose chunk is no
    longer stored; nothing to do where no vectors are stored. Reads these
    repositories' partitions only, and of chunks their ids."""
    path, ids = f"{out_dir}/vectors", repo_ids.select("repo_id").distinct()
    if not path_exists(spark, f"{path}/{TABLES['vectors']}=*"):
        return
    schema = spark.read.parquet(path).schema
    table = lambda: spark.read.schema(schema).parquet(path)
    key = StructType().add("chunk_id", StringType()).add("repo_id", StringType())
    chunks = pruned_semi_join(spark.read.schema(key).parquet(f"{out_dir}/chunks"), ids).distinct()
    stored = pruned_semi_join(table().select("repo_id", "chunk_id"), ids)
    stale, at = scratch_table(stored.join(chunks, ["repo_id", "chunk_id"], "left_anti").select("repo_id").distinct(), "stale")
    kept = pruned_semi_join(table(), stale).join(chunks, ["repo_id", "chunk_id"], "left_semi").select(*schema.names)
    fresh, kept_at = scratch_table(kept, "kept-vectors")
    write_table(fresh, path)
    # repositories that keep no vector have no rows to replace their partition
    drop_partitions(spark, path, stale.join(fresh.select("repo_id").distinct(), "repo_id", "left_anti"))
    drop_path(spark, at)
    drop_path(spark, kept_at)


# --- inventory --------------------------------------------------------------

def inventory(events: DataFrame, order_col: str = "modified") -> DataFrame:
    """Files as they are now: the latest event of each (repo_source,
    rel_path); an event without content and size is a removal."""
    return present(cat.dedup_last(events, ["repo_source", "rel_path"], order_col))


def present(files: DataFrame) -> DataFrame:
    """Latest events without removals."""
    return files.where("content is not null or size_bytes is not null")


_FILE = ["repo_source", "rel_path"]


def _event_hash(events: DataFrame) -> Column:
    """Tells events of one file and one time apart, the same way each run."""
    return F.xxhash64(*[F.col(c) for c in sorted(events.columns)])


class Inventory:
    """The stored latest event of every file: ``{out_dir}/inventory``, a
    partition for each repository and in it one for each version.

    A version is a repository's whole inventory, removals included (an older
    event that comes late must not bring a removed file back). A batch writes
    the next version of the repositories it touches and removes the older ones
    when all tables are written. A partition appears by one rename, so a
    batch that fails leaves versions that are whole; merging is idempotent, so
    it can run again from either."""

    def __init__(self, spark: SparkSession, out_dir: str, events_schema: StructType, order_col: str):
        self.spark, self.path, self.order = spark, f"{out_dir}/inventory", order_col
        self.events = list(events_schema.names)
        self.schema = StructType(list(events_schema.fields)).add("event_hash", LongType()).add(
            "repo_id", StringType()).add("version", IntegerType())

    def _table(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.path}/repo_id=*"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def versions(self, ids: DataFrame) -> DataFrame:
        """(repo_id, version) of what is stored of ``ids``."""
        return pruned_semi_join(self._table().select("repo_id", "version"), ids).distinct()

    def read(self, heads: DataFrame) -> DataFrame:
        """The latest events of the repositories at the given versions."""
        return pruned_semi_join(self._table(), heads).join(heads.select("repo_id", "version"), ["repo_id", "version"], "left_semi")

    def merge(self, batch: DataFrame) -> tuple[DataFrame, list[str]]:
        """Write the next version of the repositories in ``batch``. Returns
        (repo_id, version) of it and scratch folders to remove.

        Which events are the latest is settled on names, times and hashes; the
        content of a file moves only when it is written."""
        spark, key = self.spark, ["repo_id", *_FILE]
        events = batch.select(*self.events).withColumn("event_hash", _event_hash(batch.select(*self.events))).withColumn(
            "repo_id", paths.repo_id("repo_source"))
        events, at = scratch_table(events, "events")
        touched, touched_at = scratch_table(events.select("repo_id").distinct(), "touched")
        heads = self.versions(touched).groupBy("repo_id").agg(F.max("version").alias("version"))
        heads, heads_at = scratch_table(heads, "heads")
        new_heads = touched.join(heads, "repo_id", "left").select(
            "repo_id", (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"))
        new_heads, new_at = scratch_table(new_heads, "new-heads")
        rows = lambda: events.withColumn("_file", F.col("_metadata.file_name")).withColumn("_row", F.col("_metadata.row_index"))
        mark = lambda *more: F.struct(F.col(self.order).alias("o"), F.col("event_hash").alias("h"), *more)
        best = rows().select(*key, mark(F.col("_file").alias("f"), F.col("_row").alias("r")).alias("m")).groupBy(*key).agg(
            F.max("m").alias("m"))
        old = self.read(heads)
        known = old.select(*key, mark().alias("known"))
        wins = best.join(known, key, "left").where("known is null or struct(m.o, m.h) > known").select(
            *key, F.col("m.f").alias("_file"), F.col("m.r").alias("_row"))
        wins, wins_at = scratch_table(wins, "wins")
        kept = old.drop("version").join(wins.select(*key), key, "left_anti")
        fresh = rows().join(wins.select("_file", "_row"), ["_file", "_row"], "left_semi").drop("_file", "_row")
        merged = kept.select(*self.events, "event_hash", "repo_id").unionByName(fresh.select(*self.events, "event_hash", "repo_id"))
        write_table(merged.join(new_heads, "repo_id"), self.path, ["repo_id", "version"])
        return new_heads, [at, touched_at, heads_at, new_at, wins_at]

    def drop_older(self, heads: DataFrame) -> None:
        """Remove the versions before those of ``heads``."""
        now = heads.select("repo_id", F.col("version").alias("_now"))
        older = self.versions(heads).join(now, "repo_id").where("version < _now").select("repo_id", "version")
        drop_partitions(self.spark, self.path, older)


# --- stream -----------------------------------------------------------------

def ingest_batch(batch: DataFrame, out_dir: str, chunk_mode: str = "fixed", order_col: str = "modified") -> None:
    """Merge the events of ``batch`` into the inventory and rebuild the
    repositories it touches from there. Running it again, also after later
    batches or after a failure at any point, is harmless."""
    spark = batch.sparkSession
    stored = Inventory(spark, out_dir, batch.schema, order_col)
    heads, scratch = stored.merge(batch)
    touched = heads.select("repo_id")
    files = stored.read(heads)
    docs = fo.load_documents(present(files).drop("repo_id", "version", "event_hash"))
    write_table(docs, f"{out_dir}/documents")
    # a repository that lost its last document has no rows to replace its partitions
    having, having_at = scratch_table(docs.select("repo_id").distinct(), "having")
    gone, gone_at = scratch_table(touched.join(having, "repo_id", "left_anti"), "gone")
    delete_stored(spark, out_dir, gone, ["documents", "chunks"])
    docs = _written(spark, f"{out_dir}/documents", docs.schema, having)
    chunks = chunking.chunk(docs, mode=chunk_mode)
    write_table(chunks, f"{out_dir}/chunks")
    counted = _written(spark, f"{out_dir}/chunks", StructType().add("chunk_id", StringType()).add("repo_id", StringType()), touched)
    latest = files.groupBy(F.col("repo_id").alias("id")).agg(F.max(order_col).cast("timestamp").alias("processed_at"))
    repos = cat.build_repositories(docs, counted, cat.repo_digest(present(files)), F.lit(None).cast("timestamp")).drop("processed_at").join(
        latest, "id")
    repos, at = scratch_table(repos, "repositories")
    write_table(repos, f"{out_dir}/repositories", "id")
    delete_stored(spark, out_dir, gone, ["repositories"])
    drop_stale_vectors(spark, out_dir, touched)
    stored.drop_older(heads)
    for path in (*scratch, having_at, gone_at, at):
        drop_path(spark, path)


def _written(spark: SparkSession, path: str, schema: StructType, ids: DataFrame) -> DataFrame:
    """The given repositories' rows of a table just written."""
    if not path_exists(spark, f"{path}/repo_id=*"):
        return spark.createDataFrame([], schema)
    return pruned_semi_join(spark.read.schema(schema).parquet(path), ids)


def ingest_stream(spark: SparkSession, in_dir: str, schema, out_dir: str, checkpoint: str,
                  chunk_mode: str = "fixed", order_col: str = "modified"):
    """Start an ``availableNow`` stream of file events (parquet) into the
    tables. An event is read once; ``in_dir`` may be cleared afterwards."""
    stream = spark.readStream.schema(schema).parquet(in_dir)

    def each(batch: DataFrame, _epoch: int) -> None:
        ingest_batch(batch, out_dir, chunk_mode, order_col)

    return (stream.writeStream.foreachBatch(each)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
