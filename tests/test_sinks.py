"""Vector points and document files: written, read back, written again."""
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from srcatlas.operators import chunking, docs as dc, vectors as vec
from srcatlas.plans import inputs as I
from srcatlas.plans.q_catalog import stored_tables
from srcatlas.session import scratch_table
from srcatlas.sources import export
from srcatlas.sources.points import read_points, write_points
from srcatlas.streaming.ingest import TABLES, drop_stale_vectors, write_table


def _points(spark, shift=0.0):
    chunks = I.chunks(spark, SF_SMALL).dropDuplicates(["chunk_id"]).where("repo in ('src1', 'src2', 'src3')")
    vectors = chunks.select("chunk_id", "repo_id", F.array(F.lit(1.0 + shift).cast("float"), F.col("size").cast("float")).alias("vector"))
    return vec.embedding_points(vectors, "test")


def _rows(df):
    return sorted((r.point_id, r.repo_id, r.chunk_id, tuple(r.vector), r.payload.dim) for r in df.collect())


def test_points_are_written_read_back_and_replaced(spark, tmp_path):
    path = str(tmp_path / "vectors")
    points = _points(spark)
    write_points(points, path, dim=2)
    assert _rows(read_points(spark, path)) == _rows(points) and points.count() > 20
    write_points(points, path)  # again: the same table
    assert _rows(read_points(spark, path)) == _rows(points)
    # half of one repository's points change; one id comes twice, one vector is bad
    some = _points(spark, 1.0).where("substring(point_id, 1, 1) < '8'")
    bad = points.limit(1).withColumn("vector", F.array(F.lit(float("nan")).cast("float"), F.lit(0).cast("float")))
    write_points(some.unionByName(some.limit(3)).unionByName(bad), path, dim=2)
    changed = {r.point_id for r in some.collect()}
    want = sorted([r for r in _rows(points) if r[0] not in changed] + [r for r in _rows(some)])
    assert _rows(read_points(spark, path)) == want
    one, _ = scratch_table(points.select("repo_id").limit(1), "one")
    assert {r.repo_id for r in read_points(spark, path, one).collect()} == {one.first().repo_id}


def test_the_stream_cleans_written_points(spark, tmp_path):
    out = str(tmp_path)
    points = _points(spark)
    write_points(points, f"{out}/vectors")
    chunks = I.chunks(spark, SF_SMALL).where("repo in ('src1', 'src3')").where("size % 2 = 0")
    write_table(chunks, f"{out}/chunks", TABLES["chunks"])
    touched, _ = scratch_table(points.select("repo_id").distinct(), "touched")
    drop_stale_vectors(spark, out, touched)
    alive = {(r.repo_id, r.chunk_id) for r in chunks.select("repo_id", "chunk_id").collect()}
    want = [r for r in _rows(points) if (r[1], r[2]) in alive]
    assert _rows(read_points(spark, f"{out}/vectors")) == want and 0 < len(want) < points.count()


def test_one_document_and_metadata_file_a_repository(spark, tmp_path):
    t = stored_tables(spark, SF_SMALL)
    out = str(tmp_path / "docs")
    results = dc.document_repositories(t["repositories"], t["documents"], t["chunks"], out)
    rows = {r.output_file: r for r in results.collect() if r.success}
    files = {p.name: p.read_text() for p in (tmp_path / "docs").iterdir() if not p.name.startswith(("_", "."))}
    assert set(files) == set(rows) | {n.replace(".md", ".metadata.json") for n in rows}
    ctx = dc.repo_context(t["repositories"], t["documents"], t["chunks"])
    bodies = {r.repo_id: r.body for r in dc.render_docs(ctx).collect()}
    for name, r in rows.items():
        assert files[name] == bodies[r.repo_id]
        assert json.loads(files[name.replace(".md", ".metadata.json")])["repository"]["id"] == r.repo_id
    told = json.loads((tmp_path / "docs" / export.DONE).read_text())
    assert told == {"files": len(files), "bytes": sum(len(v.encode()) for v in files.values())}
    dc.document_repositories(t["repositories"], t["documents"], t["chunks"], out)
    assert {p.name: p.read_text() for p in (tmp_path / "docs").iterdir() if p.name in files} == files


def test_a_task_that_fails_and_runs_again(tmp_path):
    batches = [pa.record_batch({"file_name": [f"d{i}.md", f"sub/e{i}.md"], "content": [f"text {i}", None]}) for i in range(3)]

    def lost():
        yield batches[0]
        raise OSError("executor lost")

    writer = export.FileWriter(str(tmp_path))
    with pytest.raises(OSError):
        writer.write(lost())
    first = writer.write(iter(batches))
    second = writer.write(iter(batches))  # the same task again, on another executor
    assert first == second == export.Written(6, 18)
    writer.commit([first])
    names = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    assert names == sorted([export.DONE, *[f"d{i}.md" for i in range(3)], *[f"sub/e{i}.md" for i in range(3)]])
    assert (tmp_path / "d2.md").read_text() == "text 2" and (tmp_path / "sub/e1.md").read_text() == ""
    writer.abort([None])
    assert not (tmp_path / export.DONE).exists()


def test_names_that_lead_out_are_refused(spark, tmp_path):
    for name in (None, "", "/etc/x", "../x", "a//b", "a/./b", "a\\b", export.DONE):
        with pytest.raises(ValueError):
            export.checked_name(name)
    same = spark.createDataFrame([("a.md", "x"), ("a.md", "y")], "file_name string, content string")
    with pytest.raises(ValueError):
        export.write_files(same, str(tmp_path))


def test_top_samples_move_no_content(spark):
    chunks = I.chunks(spark, SF_SMALL)
    plan = dc.top_samples(chunks)._jdf.queryExecution().optimizedPlan().toString()
    for node in plan.split("\n"):
        if "WindowGroupLimit" in node or "Window [" in node or "Sort [" in node:
            assert "content" not in node
    assert "WindowGroupLimit" in plan


def test_chunk_counts_equal_chunks(spark):
    docs = I.documents(spark, SF_SMALL)
    got = {(r.repo_id, r.n) for r in dc.chunk_counts(docs).collect()}
    assert got == {(r.repo_id, r["count"]) for r in I.chunks(spark, SF_SMALL).groupBy("repo_id").count().collect()}
    texts = spark.createDataFrame([("",), (None,), ("x" * 1999,), ("x" * 2000,), ("x" * 2001,), ("ab" * 9000,)], "content string")
    for r in texts.select(chunking.fixed_count(F.col("content")).alias("n"), F.size(chunking.fixed_pieces(F.col("content"))).alias("m")).collect():
        assert r.n == max(r.m or 0, 0)


def test_dedup_within_the_row_keeps_the_last(spark):
    rows = [("d", "r", "repo", "f", "ab" * 30 + "cd" * 10 + "ab" * 30), ("e", "r", "repo", "g", "x" * 95), ("f", "r", "repo", "h", "short")]
    docs = spark.createDataFrame(rows, "doc_id string, repo_id string, repo string, file_path string, content string")
    for size, overlap in ((10, 0), (10, 4), (20, 2)):
        plain = chunking.chunk_fixed(docs, size, overlap)
        key = lambda df: sorted((r.doc_id, r.chunk_num, r.content, r.chunk_id) for r in df.collect())
        assert key(chunking.chunk_fixed(docs, size, overlap, dedup=True)) == key(chunking.dedup_chunks(plain))
    plan = chunking.chunk_fixed(docs, dedup=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
