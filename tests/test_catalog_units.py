"""Upsert, delete, dedup and digest semantics on small hand-made frames."""
from pyspark.sql import functions as F

from srcatlas.operators import catalog as cat
from srcatlas.operators.chunking import dedup_chunks


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_new_wins_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "id string, v int, t int")
    new = spark.createDataFrame([("b", 3, 30), ("b", 4, 40), ("c", 5, 50)], "id string, v int, t int")
    once = cat.upsert(old, new, ["id"], order="t")
    assert _rows(once) == [("a", 1, 10), ("b", 4, 40), ("c", 5, 50)]
    assert _rows(cat.upsert(once, new, ["id"], order="t")) == _rows(once)


def test_delete_repos_counts_and_keeps_the_rest(spark):
    tables = {
        "repositories": spark.createDataFrame([("r1",), ("r2",)], "id string"),
        "documents": spark.createDataFrame([("d1", "r1"), ("d2", "r2"), ("d3", "r2")], "doc_id string, repo_id string"),
    }
    kept, counts = cat.delete_repos(tables, spark.createDataFrame([("r2",), ("r2",)], "repo_id string"))
    assert dict(map(tuple, counts.collect())) == {"repositories": 1, "documents": 2}
    assert [r.doc_id for r in kept["documents"].collect()] == ["d1"]


def test_dedup_keeps_last_occurrence(spark):
    ch = spark.createDataFrame([("d", "h1", 0, "x"), ("d", "h1", 3, "x"), ("d", "h2", 1, "y")],
                               "doc_id string, chunk_hash string, chunk_num int, content string")
    assert _rows(dedup_chunks(ch).select("chunk_hash", "chunk_num")) == [("h1", 3), ("h2", 1)]


def test_digest_changes_with_any_file_and_not_with_order(spark):
    files = spark.createDataFrame([("/r", f"src/f{i}.py", 10, f"body {i}") for i in range(50)],
                                  "repo_source string, rel_path string, size_bytes bigint, content string")
    d0 = cat.repo_digest(files).first().content_hash
    assert cat.repo_digest(files.repartition(7)).first().content_hash == d0
    changed = files.withColumn("content", F.when(F.col("rel_path") == "src/f7.py", F.lit("x")).otherwise(F.col("content")))
    assert cat.repo_digest(changed).first().content_hash != d0
    assert cat.repo_digest(files.where(F.col("rel_path") != "src/f3.py")).first().content_hash != d0


def test_change_actions(spark):
    srcs = spark.createDataFrame([("/a", "local"), ("/b", "local"), ("https://x.org/r", "online"), ("/c", "local")],
                                 "source string, type string")
    cur = spark.createDataFrame([("/a", "h1"), ("/b", "h2"), ("/c", "")], "repo_source string, content_hash string")
    repos = spark.createDataFrame([(cat._repo_id_str("/a"), "h1"), (cat._repo_id_str("/b"), "old")], "id string, content_hash string")
    got = {r.source: r.action for r in cat.repo_changes(srcs, cur, repos).collect()}
    assert got == {"/a": "unchanged", "/b": "changed", "https://x.org/r": "update_online", "/c": "update_no_digest"}
