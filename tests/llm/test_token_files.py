"""Operators 1, 3 and 8."""
import io
import os
import sys

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases
from srcatlas.llm import op01_separator_scan as scan, op03_best_fit as fit, op08_frames as frames, queries
from srcatlas.llm.common import scratch_path
from srcatlas.llm.tokens import encoder, ids_crc32, vocabulary_path

MULTI, WORD, BYTE = (vocabulary_path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))


def ids_of(path, text):
    return [int(i) for i in encoder(path).ids(text)]


# --- 1: separator scan

@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_of_any_block_size(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files, want = [], {}
    for f, n in (("a", 0), ("b", 1), ("c", 300), ("d", 41)):
        ids = rng.integers(0, 5, n).astype("<u2")
        if f == "d":
            ids[:] = 1                                  # one document over all blocks, never closed
        path = f"file://{tmp_path}/{f}.ids"
        (tmp_path / f"{f}.ids").write_bytes(ids.tobytes())
        files.append((path, 2 * n))
        start, docs = 0, []
        for i, x in enumerate(ids):
            if x == 4:
                docs.append((start, i - start, True))
                start = i + 1
        if start < n:
            docs.append((start, n - start, False))
        want[path] = docs
    got = scan.count_tokens(spark.createDataFrame(files, "path string, length long"), 4, block).collect()
    for path, docs in want.items():
        rows = sorted((r for r in got if r.path == path), key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(len(docs)))
        assert [(r.start, r.n_tokens, r.closed) for r in rows] == docs


def test_scan_reads_real_files_listed_by_spark(spark, tmp_path):
    (tmp_path / "x.ids").write_bytes(np.array([1, 2, 4, 4], "<u2").tobytes())
    files = scan.flat_files(spark, f"file://{tmp_path}")
    assert sorted((r.n_tokens, r.closed) for r in scan.count_tokens(files, 4).collect()) == [(0, True), (2, True)]


def test_counted_documents(spark):
    got = scan.documents_counted(spark, cases.docs_table(spark).repartition(3), MULTI, 50256).collect()
    want = sorted((str(d), len(ids_of(MULTI, t)), True) for d, t in cases.DOCS)
    assert sorted((str(r.doc_id), r.n_tokens, r.closed) for r in got) == want
    assert scan.documents_counted(spark, cases.empty_docs(spark), MULTI, 50256).count() == 0


def test_op1_query(spark):
    got = {r.doc_id: r.n_tokens for r in queries.op1_separator_scan(spark, cases.SF).collect()}
    assert got == {r.doc_id: len(ids_of(MULTI, r.text)) for r in cases.given(spark, "documents").collect()}


# --- 3: best-fit packing

def check_packing(rows, docs, capacity=4096):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, text in docs:
        ids = np.array(ids_of(WORD, text) + [1], np.uint32)
        want = sorted((p, at, len(ids[at:at + capacity]), ids_crc32(ids[at:at + capacity])) for p, at in enumerate(range(0, len(ids), capacity)))
        have = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d])
        copies = sum(x == d for x, _ in docs)
        assert have == sorted(want * copies)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_op3_query(spark):
    docs = [(r.doc_id, r.text) for r in cases.given(spark, "documents").collect()]
    rows = queries.op3_best_fit(spark, cases.SF).collect()
    n = check_packing(rows, docs)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_cases(spark):
    rows = fit.packed_documents(cases.docs_table(spark).repartition(2), WORD).collect()
    check_packing(rows, cases.DOCS)
    assert fit.packed_documents(cases.empty_docs(spark), WORD).count() == 0


def test_many_buckets_and_open_bins_pack_again(spark):
    rng = np.random.default_rng(1)
    pieces = spark.createDataFrame([(i, 0, int(n), None) for i, n in enumerate(rng.integers(1, 100, 900))], "row long, piece int, length long, whole long")
    got = fit.pack(pieces, capacity=100, open_bins=8, bucket_pieces=100).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, sequences.values())) == 900
    for parts in sequences.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100
    least = -(-sum(r.length for r in got) // 100)
    assert len(sequences) <= 1.25 * least


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_best_fit_against_lists(lengths, open_bins):
    packer, bins, made = fit.BestFit(20, open_bins), [], 0           # bins: [number, free], oldest first
    for n in lengths:
        b, offset = packer.add(n)
        fits = [x for x in bins if x[1] >= n]
        if fits:
            tight = min(x[1] for x in fits)
            assert any(x[0] == b and x[1] == tight for x in fits) and offset == 20 - tight
            x = next(x for x in bins if x[0] == b)
        else:
            if len(bins) == open_bins:
                low = min(x[1] for x in bins)
                gone = [x for x in bins if x[1] == low]
                assert len(gone) >= 1
                still = packer.still_open() | {b}
                bins = [x for x in bins if x[0] in still or x[1] != low] if len(gone) > 1 else [x for x in bins if x[1] != low]
            assert b == made and offset == 0
            x = [b, 20]
            made += 1
            bins.append(x)
        x[1] -= n
        bins = [x for x in bins if x[1]]
        assert packer.still_open() == {x[0] for x in bins} and len(bins) <= open_bins


# --- 8: frames

def file_of(docs):
    out = io.BytesIO()
    w = frames.FrameWriter(out)
    for d, ids in docs:
        w.add(d, np.array(ids, np.uint32))
    w.close()
    return out


def test_frames_round_trip_and_only_wanted_frames_are_read():
    docs = [(7, [1, 2, 3]), (None, []), (-3, list(range(5000))), (2 ** 60, [70_000])]
    out = file_of(docs)

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            got = super().read(n)
            Counting.total += len(got)
            return got

    r = frames.FrameReader(Counting(out.getvalue()))
    assert [(r.doc_id(i), r.ids(i).tolist()) for i in range(len(r))] == docs
    Counting.total = 0
    r = frames.FrameReader(Counting(out.getvalue()))
    r.ids(0)
    assert Counting.total < len(out.getvalue()) - int(r.entries["packed"][2]) + 1
    import zstandard
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True)
    assert stream.read() == b"".join(np.array(ids, "<u4").tobytes() for _, ids in docs)


def test_damage_is_seen():
    out = file_of([(1, [5, 6, 7]), (2, [8])])
    entry = frames.FrameReader(io.BytesIO(out.getvalue())).entries[0]
    raw = bytearray(out.getvalue())
    raw[int(entry["packed"]) - 1] ^= 0xFF
    with pytest.raises(Exception):
        frames.FrameReader(io.BytesIO(bytes(raw))).ids(0)
    table = bytearray(out.getvalue())
    table[-10] ^= 0xFF                                  # the last entry's checksum
    with pytest.raises(ValueError, match="checksum"):
        frames.FrameReader(io.BytesIO(bytes(table))).ids(1)
    with pytest.raises(ValueError, match="seek table"):
        frames.FrameReader(io.BytesIO(out.getvalue()[:-1]))
    assert len(frames.FrameReader(file_of([]))) == 0


def test_op8_query(spark):
    got = queries.op8_frames(spark, cases.SF).orderBy("doc_id").collect()
    start, want = 0, []
    for r in cases.given(spark, "documents").orderBy("doc_id").collect():
        ids = np.array(ids_of(BYTE, r.text) + [0], np.uint32)
        want.append((r.doc_id, start, len(ids), ids_crc32(ids)))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_frames_cases_in_many_files(spark):
    folder = scratch_path(spark, "frames-test")
    files = frames.write_frames(cases.docs_table(spark).repartition(4), folder, BYTE, 0, file_text_bytes=4000)
    assert files.count() > 1
    got = sorted((str(r.doc_id), r.ids) for r in frames.read_frames(spark, files).collect())
    assert got == sorted((str(d), ids_of(BYTE, t) + [0]) for d, t in cases.DOCS)
    digests = frames.document_digests(files).orderBy("start").collect()
    assert [r.start for r in digests] == np.cumsum([0] + [r.n_tokens for r in digests])[:-1].tolist()
    known = [r.doc_id for r in digests if r.doc_id is not None]
    assert known == sorted(known)
    some = frames.read_frames(spark, files, spark.createDataFrame([(2,), (9,), (777,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in some) == [2, 2, 9]


def test_frames_of_nothing(spark):
    assert frames.documents_as_frames(spark, cases.empty_docs(spark), BYTE).count() == 0


def test_plans_have_no_python_shuffle_of_ids(spark):
    """Only names and places move between the scan and its result."""
    df = cases.docs_table(spark, extra=False).select("doc_id", F.lit("x").alias("text"))
    plan = fit.cut_documents(df, WORD)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
