"""Incremental refresh, stream ingest and partition invariance."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from srcatlas.operators import catalog as cat
from srcatlas.plans import inputs as I
from srcatlas.plans.q_catalog import current_tables, processed_at, stored_tables
from srcatlas.session import scratch_table
from srcatlas.streaming.ingest import TABLES, delete_stored, ingest_batch, ingest_stream, rebuilt, refresh, write_table


def _digest_rows(df):
    return sorted((r.repo_id, r.content_hash) for r in df.collect())


def test_refresh_rebuilds_only_changed(spark):
    stored = stored_tables(spark, SF_SMALL)
    cur = cat.repo_digest(I.files(spark, SF_SMALL))
    srcs = I.files(spark, SF_SMALL).select(F.col("repo_source").alias("source")).distinct().withColumn("type", F.lit("local"))
    ch = cat.repo_changes(srcs, cur, stored["repositories"])
    todo = ch.where(F.col("action") != "unchanged").select("repo_id")
    tables, rebuilt = refresh(stored, I.files(spark, SF_SMALL), todo, processed_at())
    assert {r.repo_id for r in rebuilt.collect()} == {r.repo_id for r in todo.collect()}
    # after the refresh, every repository's digest equals today's
    now = current_tables(spark, SF_SMALL)["repositories"]
    assert _digest_rows(tables["repositories"].select(F.col("id").alias("repo_id"), "content_hash")) == \
        _digest_rows(now.select(F.col("id").alias("repo_id"), "content_hash"))
    # a second refresh with nothing to do changes nothing
    again, _ = refresh(tables, I.files(spark, SF_SMALL), todo.limit(0), processed_at())
    assert again["documents"].count() == tables["documents"].count()


def _events(spark, when):
    return I.files(spark, SF_SMALL).withColumn("modified", F.to_timestamp(F.lit(when)))


def _write(df, src, name):
    df.coalesce(1).write.parquet(f"{src}/{name}")


def _stream(spark, src, out, ck, schema):
    q = ingest_stream(spark, f"{src}/*", schema, out, ck)
    q.awaitTermination(180)
    assert q.exception() is None


def _stored(spark, out):
    docs, chunks, repos = (spark.read.parquet(f"{out}/{t}") for t in ("documents", "chunks", "repositories"))
    return (sorted((r.doc_id, r.file_hash) for r in docs.collect()), sorted((r.chunk_id, r.chunk_num) for r in chunks.collect()),
            sorted((r.id, r.total_files, r.total_chunks, r.content_hash) for r in repos.collect()))


def _expected(spark, files):
    t = rebuilt(files, F.lit(None).cast("timestamp"))
    return (sorted((r.doc_id, r.file_hash) for r in t["documents"].collect()), sorted((r.chunk_id, r.chunk_num) for r in t["chunks"].collect()),
            sorted((r.id, r.total_files, r.total_chunks, r.content_hash) for r in t["repositories"].collect()))


def test_stream_split_replayed_and_removed(spark, tmp_path):
    """A repository split over two batches, a replayed batch, a removed file
    and a removed repository all end as one batch of what is left."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    first = _events(spark, "2025-01-01 00:00:00")
    schema = first.schema
    _write(first.where("doc_id % 2 = 0"), src, "a")
    _stream(spark, src, out, str(tmp_path / "ck"), schema)
    _write(first.where("doc_id % 2 = 1"), src, "b")
    _stream(spark, src, out, str(tmp_path / "ck"), schema)
    whole = _expected(spark, first)
    assert _stored(spark, out) == whole
    # replay from the beginning
    _stream(spark, src, out, str(tmp_path / "ck2"), schema)
    assert _stored(spark, out) == whole
    # a file of src1 goes, all of src2 goes, a file of src3 changes
    gone = (F.col("repo") == "src2") | ((F.col("repo") == "src1") & (F.col("doc_id") == F.lit(
        first.where("repo = 'src1'").agg(F.min("doc_id")).first()[0])))
    later = _events(spark, "2025-02-01 00:00:00")
    removed = later.where(gone).withColumn("content", F.lit(None).cast("string")).withColumn("size_bytes", F.lit(None).cast("long"))
    changed = later.where("repo = 'src3' and doc_id % 40 = 3").withColumn("content", F.concat("content", F.lit(" and some more")))
    _write(removed.unionByName(changed), src, "c")
    _stream(spark, src, out, str(tmp_path / "ck"), schema)
    now = first.where(~gone).join(changed.select("rel_path", "repo"), ["rel_path", "repo"], "left_anti").unionByName(changed)
    assert _stored(spark, out) == _expected(spark, now)


def test_stream_clears_vectors_of_chunks_that_are_gone(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    first = _events(spark, "2025-01-01 00:00:00")
    _write(first, src, "a")
    _stream(spark, src, out, str(tmp_path / "ck"), first.schema)
    vectors = spark.read.parquet(f"{out}/chunks").select("chunk_id", "repo_id", F.array(F.lit(1.0)).alias("vector")).distinct()
    write_table(vectors, f"{out}/vectors")
    ids = lambda name: {(r.repo_id, r.chunk_id) for r in spark.read.parquet(f"{out}/{name}").collect()}
    before = ids("vectors")
    later = _events(spark, "2025-02-01 00:00:00")
    removed = later.where("repo = 'src2'").withColumn("content", F.lit(None).cast("string")).withColumn("size_bytes", F.lit(None).cast("long"))
    changed = later.where("repo = 'src3' and doc_id % 40 = 3").withColumn("content", F.concat("content", F.lit(" and some more")))
    _write(removed.unionByName(changed), src, "b")
    _stream(spark, src, out, str(tmp_path / "ck"), first.schema)
    after = ids("vectors")
    assert after == before & ids("chunks") and after < before
    assert len({r for r, _ in before} - {r for r, _ in after}) == 1


def _file_events(spark, rows):
    """(repo, path, day, text or None for a removal)"""
    return spark.createDataFrame(
        [(i, r, f"/data/{r}", p, None if t is None else len(t), t) + (d,) for i, (r, p, d, t) in enumerate(rows)],
        "doc_id long, repo string, repo_source string, rel_path string, size_bytes long, content string, day int").withColumn(
        "modified", F.to_timestamp(F.date_add(F.lit("2025-01-01"), F.col("day")))).drop("day")


def _texts(spark, out):
    return {(r.repo, r.file_path): r.content for r in spark.read.parquet(f"{out}/documents").collect()}


def test_a_batch_reads_itself_and_its_repositories_only(spark, tmp_path):
    """Earlier events and other repositories' partitions are overwritten with
    bytes that no reader could bear; ten batches still end right."""
    import pathlib
    src, out, want = tmp_path / "src", str(tmp_path / "out"), {}
    for batch in range(10):
        mine, other = f"r{batch % 3}", f"new{batch}"
        rows = [(mine, f"src/f{batch % 2}.py", batch, f"body of batch {batch} for {mine}"), (other, "a.py", batch, "only file " * 3)]
        _write(_file_events(spark, rows), str(src), f"b{batch}")
        # everything that this batch has no need of becomes unreadable
        spoiled = {}
        for f in [*src.glob("b*/*.parquet"), *pathlib.Path(out).glob("*/*=*/**/*.parquet")]:
            repo = next((q.split("=")[1] for q in f.parts if q.startswith(("repo_id=", "id="))), None)
            needed = f.parent.name == f"b{batch}" or repo == cat._repo_id_str(f"/data/{mine}")
            if not needed:
                spoiled[f] = f.read_bytes()
                f.write_bytes(b"not a table")
        _stream(spark, str(src), out, str(tmp_path / "ck"), _file_events(spark, rows).schema)
        for f, data in spoiled.items():
            f.write_bytes(data)
        want |= {(r, p): t.strip() for r, p, _, t in rows}
    assert _texts(spark, out) == want
    versions = {f.parent.name for f in pathlib.Path(out).glob("inventory/*/version=*/*.parquet")}
    assert len(list(pathlib.Path(out).glob("inventory/*/version=*"))) == 13 and "version=4" in versions


def test_a_late_older_event_changes_nothing(spark, tmp_path):
    out = str(tmp_path)
    day = lambda *rows: ingest_batch(_file_events(spark, rows), out)
    day(("a", "x.py", 5, "the newest text of x"), ("a", "y.py", 1, "text of y, long enough"), ("b", "z.py", 1, "some text of z"))
    day(("a", "y.py", 7, None), ("a", "x.py", 3, "an older text of x"))
    assert _texts(spark, out) == {("a", "x.py"): "the newest text of x", ("b", "z.py"): "some text of z"}
    day(("a", "y.py", 6, "late, but older than its removal"))
    assert set(_texts(spark, out)) == {("a", "x.py"), ("b", "z.py")}
    # a repository whose only file is no document any more
    day(("b", "z.py", 9, "short"))
    assert set(_texts(spark, out)) == {("a", "x.py")}
    assert {r.id for r in spark.read.parquet(f"{out}/repositories").collect()} == {cat._repo_id_str("/data/a")}
    # the same event twice in a batch, and a batch run twice
    for _ in range(2):
        day(("b", "z.py", 10, "back with a longer text"), ("b", "z.py", 10, "back with a longer text"))
    assert _texts(spark, out)[("b", "z.py")] == "back with a longer text"
    assert spark.read.parquet(f"{out}/chunks").count() == 2


def test_a_failed_batch_can_run_again(spark, tmp_path, monkeypatch):
    from srcatlas.streaming import ingest
    out = str(tmp_path)
    ingest_batch(_file_events(spark, [("a", "x.py", 1, "first text of the file")]), out)
    batch = _file_events(spark, [("a", "x.py", 2, "second text of the file"), ("b", "y.py", 2, "a new repository")])
    for step in ("load_documents", "chunk", "build_repositories"):
        owner = {"load_documents": ingest.fo, "chunk": ingest.chunking, "build_repositories": ingest.cat}[step]
        with monkeypatch.context() as m:
            m.setattr(owner, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                ingest_batch(batch, out)
    ingest_batch(batch, out)
    assert _texts(spark, out) == {("a", "x.py"): "second text of the file", ("b", "y.py"): "a new repository"}
    assert spark.read.parquet(f"{out}/inventory").count() == 2


def test_reads_by_computed_ids_prune_partitions(spark, tmp_path):
    t = stored_tables(spark, SF_SMALL)
    path = str(tmp_path / "documents")
    write_table(t["documents"], path)
    some = t["repositories"].orderBy("id").limit(2).select(F.col("id").alias("repo_id"))
    ids, _ = scratch_table(some, "ids")
    got = cat.read_table(spark, path, ids)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(repo_id" in plan
    keep = {r.repo_id for r in some.collect()}
    assert got.count() == t["documents"].where(F.col("repo_id").isin(*keep)).count()
    for f in (tmp_path / "documents").glob("repo_id=*/*.parquet"):
        if f.parent.name.split("=")[1] not in keep:
            f.write_bytes(b"not a table")
    assert {r.repo_id for r in cat.read_table(spark, path, ids, schema=t["documents"].schema).collect()} == keep


def test_stored_tables_upsert_and_delete(spark, tmp_path):
    out = str(tmp_path)
    t = stored_tables(spark, SF_SMALL)
    vectors = t["chunks"].select("chunk_id", "repo_id", F.array(F.lit(1.0)).alias("vector"))
    for name, df in (*t.items(), ("vectors", vectors), ("inventory", t["documents"].select("repo_id", "file_path"))):
        write_table(df.withColumn("repo_id", F.col("id")) if name == "repositories" else df, f"{out}/{name}", TABLES[name])
    some = t["repositories"].orderBy("id").limit(2).select(F.col("id").alias("repo_id"))
    ids = [r.repo_id for r in some.collect()]
    pruned = cat.read_table(spark, f"{out}/documents", ids)
    assert pruned.count() == t["documents"].where(F.col("repo_id").isin(*ids)).count()
    assert "PartitionFilters: [isnotnull(repo_id" in pruned._jdf.queryExecution().executedPlan().toString() or \
        "PartitionFilters: [repo_id" in pruned._jdf.queryExecution().executedPlan().toString()
    # replace one repository's chunks
    one = t["chunks"].where(F.col("repo_id") == ids[0]).limit(1)
    before = spark.read.parquet(f"{out}/chunks").count()
    n = t["chunks"].where(F.col("repo_id") == ids[0]).count()
    write_table(one, f"{out}/chunks")
    assert spark.read.parquet(f"{out}/chunks").count() == before - n + 1
    delete_stored(spark, out, some)
    for name, col in TABLES.items():
        left = spark.read.parquet(f"{out}/{name}")
        assert left.where(F.col(col).isin(*ids)).isEmpty() and not left.isEmpty()


def test_upsert_of_every_table(spark):
    for name, key in (("documents", "doc_id"), ("chunks", "chunk_id")):
        old = stored_tables(spark, SF_SMALL)[name]
        old = cat.dedup_last(old, [key], "chunk_num") if name == "chunks" else old
        new = old.limit(5).withColumn("content", F.lit("new"))
        out = cat.upsert(old, new.unionByName(new), [key])
        assert out.count() == old.count() and out.where("content = 'new'").count() == 5
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, vector array<double>")
    out = cat.upsert(vectors, spark.createDataFrame([("b", [3.0]), ("c", [4.0])], vectors.schema), ["chunk_id"])
    assert sorted((r.chunk_id, r.vector) for r in out.collect()) == [("a", [1.0]), ("b", [3.0]), ("c", [4.0])]


def test_partition_invariance(spark):
    import __spark_entry__ as E
    q = E.queries()["chunk_distribution"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, q(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    b = sorted(map(tuple, q(spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
