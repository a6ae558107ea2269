"""Chunks and vectors: what a task holds and how often it computes it."""
from srcatlas.operators import vectors as vec
from srcatlas.operators.chunking import chunk, dedup_chunks, split_buffered, split_recursive


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(df, node: str) -> list[str]:
    return [line for line in _plan(df).splitlines() if f"{node} " in line]


def test_short_documents_reach_python_row_by_row(spark):
    texts = {"a": "word " * 1500, "b": "", "c": None, "d": "same\n\n" * 3}
    docs = spark.createDataFrame([(k, "r", "repo", f"{k}.py", v) for k, v in texts.items()],
                                 "doc_id string, repo_id string, repo string, file_path string, content string")
    for mode, split in (("recursive", split_recursive), ("buffered", split_buffered)):
        df = chunk(docs, mode=mode)
        assert len(_lines(df, "BatchEvalPython")) == 1
        got = sorted((r.doc_id, r.chunk_num, r.content) for r in df.collect())
        assert got == sorted((k, i, c) for k, v in texts.items() if v for i, c in enumerate(split(v)))
        assert dedup_chunks(df).count() == len({(k, c) for k, _, c in got})


def test_vectors_are_computed_once(spark):
    df = vec.embed(spark.createDataFrame([("1", "alpha beta alpha"), ("2", "...")], "chunk_id string, content string"), dim=16)
    assert [r.chunk_id for r in df.collect()] == ["1"]
    assert not any("UDF" in line for line in _lines(df, "Filter"))
