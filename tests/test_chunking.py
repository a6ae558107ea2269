"""Chunking invariants (recursive / buffered / fixed)."""
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from srcatlas.operators.chunking import split_buffered, split_recursive

ALPHABET = st.sampled_from(list("abcdefgh ") + ["\n", "\n\n", "  "])


def _nonspace(s):
    return re.sub(r"\s+", "", s)


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, min_size=0, max_size=3000).map("".join),
       st.integers(min_value=20, max_value=300), st.integers(min_value=0, max_value=15))
def test_recursive_invariants(text, size, overlap):
    chunks = split_recursive(text, size, overlap)
    for c in chunks:
        assert c == c.strip() and c
        assert len(c) <= size
    # every non-space character of the text is covered, in order
    joined = _nonspace("".join(chunks))
    src = _nonspace(text)
    it = iter(joined)
    assert all(ch in it for ch in src)


def test_no_separators_equals_fixed_stride():
    text = "x" * 7000
    chunks = split_recursive(text, 2000, 200)
    assert [len(c) for c in chunks] == [2000, 2000, 2000, 1600]
    starts = [0, 1800, 3600, 5400]
    assert chunks == [text[s:s + 2000] for s in starts]


def test_separator_kept_at_piece_start():
    text = ("a" * 1500) + "\n\n" + ("b" * 1500)
    chunks = split_recursive(text, 2000, 200)
    assert chunks == ["a" * 1500, "b" * 1500]


def test_overlap_carried_between_chunks():
    words = " ".join(f"w{i:04d}" for i in range(1000))
    chunks = split_recursive(words, 2000, 200)
    assert len(chunks) > 1
    for a, b in zip(chunks, chunks[1:]):
        tail = a[-150:]
        assert b.startswith(tail.split(" ", 1)[1][:20]) or set(a.split()) & set(b.split())


def test_buffered_no_overlap_across_buffers():
    line = "y" * 99 + "\n"
    text = line * 300  # 30,000 chars, buffers close at >= 4000
    chunks = split_buffered(text, 2000, 200)
    assert sum(len(c) for c in chunks) >= len(text.replace("\n", "")) - 10
    assert all(len(c) <= 2000 for c in chunks)


def test_fixed_chunks_spark(spark):
    from srcatlas.operators.chunking import chunk_fixed
    df = spark.createDataFrame([("d1", "r", "src", "a.py", "z" * 4500)],
                               "doc_id string, repo_id string, repo string, file_path string, content string")
    rows = sorted((r.chunk_num, r.size) for r in chunk_fixed(df).collect())
    assert rows == [(0, 2000), (1, 2000), (2, 900)]


def test_recursive_spark_matches_python(spark):
    from srcatlas.operators.chunking import chunk
    text = ("para one. " * 150) + "\n\n" + ("line two\n" * 300)
    df = spark.createDataFrame([("d1", "r", "src", "a.md", text)],
                               "doc_id string, repo_id string, repo string, file_path string, content string")
    got = [r.content for r in chunk(df, mode="recursive").orderBy("chunk_num").collect()]
    assert got == split_recursive(text)


def test_revise_with_checkpoint_matches(spark):
    from pyspark.sql import functions as F
    from srcatlas.operators.docs import revise
    df = spark.createDataFrame([(1, "Here\n# {{Project Name}}\nDescribe the x", "r"), (2, "# fine", "r")],
                               "id int, draft string, repo_name string")
    vals = {k: F.col("repo_name") for k in ["repo_name", "languages", "frameworks", "repo_source", "project_dir"]}
    a = sorted(map(tuple, revise(df, vals, rounds=5).select("id", "final_score", "rounds", "final_draft").collect()))
    b = sorted(map(tuple, revise(df, vals, rounds=5, checkpoint_every=2).select("id", "final_score", "rounds", "final_draft").collect()))
    assert a == b and a[0][1] >= 85


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["ab", "é", "\U0001f600", "\n", " "]), min_size=1, max_size=120).map("".join),
       st.integers(min_value=2, max_value=20), st.integers(min_value=0, max_value=19))
def test_fixed_pieces_are_windows(spark, text, size, overlap):
    from pyspark.sql import functions as F
    from srcatlas.operators.chunking import fixed_pieces
    if overlap >= size:
        return
    stride = size - overlap
    n = max(0, -(-(len(text) - size) // stride)) + 1
    got = spark.createDataFrame([(text,)], "t string").select(fixed_pieces(F.col("t"), size, overlap)).first()[0]
    assert got == [text[i * stride:i * stride + size] for i in range(n)]


def test_fixed_chunks_cost_in_proportion(spark):
    import time

    from pyspark.sql import functions as F
    from srcatlas.operators.chunking import chunk_fixed

    def cost(millions):
        d = spark.range(1).select(F.lit("d").alias("doc_id"), F.lit("r").alias("repo_id"), F.lit("r").alias("repo"),
                                  F.lit("f").alias("file_path"), F.expr(f"repeat('0123456789', {millions * 100_000})").alias("content"))
        t0 = time.perf_counter()
        chunk_fixed(d).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    cost(1)
    assert cost(16) < 8 * cost(4) + 1


def test_dedup_carries_no_content_through_the_aggregate(spark):
    from srcatlas.operators.chunking import dedup_chunks
    df = spark.createDataFrame([("d", "h", 0, "x"), ("d", "h", 2, "x"), ("d", "g", 1, "y")], "doc_id string, chunk_hash string, chunk_num int, content string")
    out = dedup_chunks(df)
    assert sorted((r.chunk_hash, r.chunk_num) for r in out.collect()) == [("g", 1), ("h", 2)]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_sql_of_the_splitters_on_random_texts():
    """The DuckDB statement and the splitter agree on every separator."""
    import random

    import duckdb
    from srcatlas.operators.chunking import split_buffered, split_recursive
    from srcatlas.plans import duck_chunks
    rng = random.Random(11)
    texts = ["".join(rng.choices(["ab", "c", " ", "\n", "\n\n", "\n\n\n", "longerword", "x" * 45, "é日"],
                                 weights=[6, 5, 6, 2, 1, 1, 2, .5, 1], k=rng.randrange(1, 120))).strip() for _ in range(150)]
    texts += ["x" * 130, "a", "\n\nab".strip(), "word " * 60]
    texts = [t for t in texts if t]
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id VARCHAR, repo_id VARCHAR, content VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, 'r', ?)", [(str(i), t) for i, t in enumerate(texts)])
    for buffered, split in ((False, split_recursive), (True, split_buffered)):
        for size, overlap in ((40, 8), (25, 0), (60, 30)):
            ctes = ", ".join(f"{n} AS ({body})" for n, body in duck_chunks.chunks_sql(buffered, size, overlap))
            got = con.execute(f"WITH RECURSIVE {ctes} SELECT doc_id, chunk_num, content FROM split_chunks").fetchall()
            want = [(str(i), n, c) for i, t in enumerate(texts) for n, c in enumerate(split(t, size, overlap))]
            assert sorted(got) == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab", "c", " ", "\n", "\n\n", "\n\n\n", "longerword", "x" * 45, "é日", "\U0001f600", "\u3000", "\x1c"]),
                min_size=1, max_size=300).map("".join),
       st.sampled_from([(5, 0), (25, 6), (40, 39), (60, 15)]), st.integers(min_value=0, max_value=200),
       st.sampled_from([["\n\n", "\n", " ", ""], ["aba", "c", ""], ["\n", ""]]))
def test_blocks_of_a_text_give_the_chunks_of_the_whole(text, sizes, more, separators):
    import pandas as pd
    from srcatlas.operators import long_texts as lt
    size, overlap = sizes
    blocks = list(lt.text_blocks(text, size, separators, size + more))
    windows = [lt.Windows(part, lo, hi, len(text), last, size, overlap, separators) for _, lo, hi, last, part in blocks]
    tables = pd.DataFrame([("d", b, lo, hi, *w.table(size)) for (b, lo, hi, _, _), w in zip(blocks, windows)],
                          columns=["doc_id", "block", "lo", "hi", "entry", "exit", "chunks"])
    got = []
    for r in lt.follow(tables.sample(frac=1, random_state=3)).itertuples():
        assert r.first_num == len(got)
        got += windows[r.block].chunks(r.start)
    assert got == split_recursive(text, size, overlap, separators)


def test_long_documents_are_cut_by_many_tasks(spark):
    import random

    import pytest
    from pyspark.sql import functions as F
    from srcatlas.operators import long_texts as lt
    from srcatlas.operators.chunking import chunk
    rng = random.Random(5)
    words = ["word ", "line\n", "end.\n\n", "x" * 300, " ", "\n\n\n", "日本 "]
    texts = {"long": "".join(rng.choices(words, k=20_000)), "chars": "x" * 90_000, "blank": " \n" * 40_000, "lines": "\n" * 70_001 + "a",
             "short": "some words " * 40, "none": None, "empty": ""}
    df = spark.createDataFrame([(k, "r", "src", k + ".md", v) for k, v in texts.items()],
                               "doc_id string, repo_id string, repo string, file_path string, content string")
    got = {}
    for r in chunk(df, mode="recursive", block_chars=8192).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_num, r.content))
    want = {k: list(enumerate(split_recursive(v))) for k, v in texts.items() if v}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    got = {}
    for r in chunk(df, mode="buffered", block_chars=8192).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_num, r.content))
    want = {k: list(enumerate(split_buffered(v))) for k, v in texts.items() if v}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    # the chunks of one document come from several partitions
    one = lt.split_long(df.where("doc_id = 'long'"), 2000, 200, ["\n\n", "\n", " ", ""], 8192)
    assert one.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    with pytest.raises(ValueError):
        lt.split_long(df, 2000, 200, ["\n\n", "\n"], 8192)


def test_recursive_cost_in_proportion():
    import time

    def cost(n):
        t0 = time.perf_counter()
        split_recursive("word " * n)
        return time.perf_counter() - t0

    assert cost(80_000) < 8 * cost(20_000) + .5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["ab ", "word", "\n", "\n\n", "x" * 70, "é"]), min_size=1, max_size=300).map("".join),
       st.sampled_from([5, 20, 60]), st.integers(min_value=1, max_value=500))
def test_blocks_of_buffers_give_the_chunks_of_the_whole(text, size, block_chars):
    from srcatlas.operators.long_texts import buffer_blocks
    parts = list(buffer_blocks(text, size, block_chars))
    assert "".join(parts) == text and all(len(p) >= block_chars for p in parts[:-1])
    assert [c for p in parts for c in split_buffered(p, size, size // 4)] == split_buffered(text, size, size // 4)


def test_wide_side_is_copied_to_the_parts_that_hold_a_row(spark):
    from srcatlas.operators.joins import salted_join
    big = spark.createDataFrame([(k, i) for k, n in (("a", 40), ("b", 1), ("c", 3), (None, 2)) for i in range(n)], "k string, i int")
    small = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "z")], "k string, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        rows = [sorted(map(str, salted_join(big, small, ["k"], how, "i", wide=w).collect())) for w in (False, True)]
        assert rows[0] == rows[1] == sorted(map(str, big.join(small, "k", how).collect()))
