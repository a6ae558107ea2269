"""Keywords counted within the row, and of ids that several rows share."""
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from srcatlas.operators import corpus_terms as ct
from srcatlas.operators import keywords as kw

ROWS = [(1, "alpha beta alpha gamma delta"), (2, "beta beta <b>tag</b> zeta"), (3, "alpha gamma"), (3, "gamma beta alpha"),
        (4, ""), (5, "x"), (None, "beta omega"), (None, "omega omega"), (6, "only once here")]
SCHEMA = "doc_id long, text string"


def _counts() -> dict:
    out = defaultdict(Counter)
    for i, text in ROWS:
        t = re.findall(r"\w{2,}", text.lower())
        out[i].update(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
    return {i: c for i, c in out.items() if c}


def _best(weights: dict, keep=lambda t: True) -> set:
    out = set()
    for i, w in weights.items():
        norm = math.sqrt(sum(x * x for x in w.values()))
        top = sorted((-x / norm, t) for t, x in w.items() if keep(t))[:3]
        out |= {(i, t, round(-s, 6), r) for r, (s, t) in enumerate(top, 1)}
    return out


def _rows(df) -> list:
    return sorted(((r.doc_id, r.term, round(r.score, 6), r["rank"]) for r in df.collect()), key=str)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_text_by_itself(spark):
    df = kw.keywords(spark.createDataFrame(ROWS, SCHEMA), top_n=3, stop_words=[])
    assert _rows(df) == sorted(_best(_counts(), lambda t: " " not in t and len(t) > 2), key=str)
    assert "posexplode" in _plan(df)        # ranked within the row


@pytest.mark.parametrize("per_id", [True, False])
def test_candidates_meet_the_texts_by_id(spark, per_id):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    cand = kw.candidate_terms(docs, stop_words=[], per_id=per_id)
    if per_id:
        assert cand.count() == cand.select("doc_id").distinct().count()
    want = defaultdict(set)
    for i, text in ROWS:
        want[i] |= set(re.findall(r"\w{3,}", re.sub("<[^>]+>", "", text.lower())))
    counts = _counts()
    got = _rows(kw.keywords(docs, top_n=3, stop_words=[], candidates=cand))
    expected = {r for i in counts if i is not None for r in _best({i: counts[i]}, lambda t, i=i: t in want[i])}
    assert got == sorted(expected, key=str)


def test_candidates_of_two_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha beta gamma"), (2, "alpha beta")], SCHEMA)
    cand = spark.createDataFrame([(1, "alpha beta"), (1, "gamma"), (1, "omega"), (1, "gamma"), (2, "beta")], "doc_id long, term string")
    got = kw.keywords(docs, stop_words=[], candidates=cand).select("doc_id", "term", "rank").collect()
    assert sorted(map(tuple, got)) == [(1, "alpha beta", 1), (1, "gamma", 2), (2, "beta", 1)]


def test_counts_within_the_row(spark):
    df = spark.createDataFrame([(["b", "a", "b", "c", "b", "a"],), ([],)], "t array<string>")
    got = [[(x.n, x.term) for x in r.c] for r in df.select(kw.counted(F.col("t")).alias("c")).collect()]
    assert got == [[(2, "a"), (3, "b"), (1, "c")], []]


def test_corpus_terms_stay_in_their_part(spark):
    df = kw.keywords_corpus(spark.createDataFrame(ROWS, SCHEMA), top_n=3, stop_words=[])
    counts = _counts()
    df_ = Counter(t for c in counts.values() for t in c)
    weights = {i: {t: n * (math.log((1 + len(ROWS)) / (1 + df_[t])) + 1) for t, n in c.items()} for i, c in counts.items()}
    assert _rows(df) == sorted(_best(weights), key=str)
    assert "Join" not in _plan(df)          # no pair of text and term is shuffled to its frequency


def test_corpus_terms_are_no_rows(spark):
    # terms go out and their frequencies come back in blocks: nothing is exploded, and no term is sorted as a row
    plan = _plan(kw.keywords_corpus(spark.createDataFrame(ROWS, SCHEMA)))
    assert "Generate" not in plan and "Window" not in plan
    assert not [x for x in plan.splitlines() if "Exchange" in x and "term" in x.split("Exchange")[1]]


def _part(number: int, rows: list) -> pa.Table:
    ids, words = zip(*rows)
    return pa.table({"_part": pa.array([number] * len(rows), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "words": pa.array(words)})


@pytest.mark.parametrize("too_many", [1 << 63, 1])
def test_blocks_of_terms(monkeypatch, too_many):
    monkeypatch.setattr(ct, "TOO_MANY", too_many)
    rows = [(7, "b ab a a ab"), (None, "é b"), (7, "ab a"), (5, ""), (None, "b"), (8, "a_ a0 ab")]
    part = ct.PartTerms(ct._worded(_part(0, rows)), 5)
    want = defaultdict(Counter)
    for i, text in rows:
        w = text.split()
        want[i].update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    names = part.strings(np.arange(len(part.codes))).to_pylist()
    assert names == sorted({t for c in want.values() for t in c}, key=str.encode)
    got = sorted(((part.ids[int(d)].as_py(), names[t], int(n)) for d, t, n in zip(part.doc, part.term, part.n)), key=str)
    assert got == sorted(((i, t, n) for i, c in want.items() for t, n in c.items()), key=str)

    # what comes back for a block is in the order of its terms
    parts = [_part(k, rows[k:] + [(100 + k, "b ab zz")]) for k in range(3)]
    blocks = pa.concat_tables([ct.blocks_of(5)(p) for p in parts])
    back = pa.concat_tables([ct.frequencies(blocks.filter(pc.equal(blocks["_bucket"], b))) for b in set(blocks["_bucket"].to_pylist())])
    seen = []
    for k, p in enumerate(parts):
        part, df = ct.PartTerms(ct._worded(p), 5), {}
        for x in back.filter(pc.equal(back["_part"], k)).to_pylist():
            mine = part.order[part.ends[x["_bucket"]]:part.ends[x["_bucket"] + 1]]
            df |= zip(part.strings(mine).to_pylist(), ct._unpacked(x["df"]).tolist(), strict=True)
        assert len(df) == len(part.codes)
        seen.append((part, df))
    total = Counter(t for part, _ in seen for t in part.strings(part.term).to_pylist())
    assert all(df[t] == total[t] for _, df in seen for t in df)


def test_parts_without_a_word():
    assert len(ct.blocks_of(4)(_part(1, [(1, ""), (2, "")]))) == 0
    assert len(ct.best_of(4, 3)(_part(1, [(1, "")]), pa.table({}))) == 0


def test_blocks_are_smaller_than_their_terms():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{a:x}" for a in rng.integers(4096, 60000, 200))) for i in range(300)]
    part = _part(0, rows)
    blocks = ct.blocks_of(16)(part)
    terms = sum(int.from_bytes(x.as_py()[:8], "little") for x in blocks["terms"])
    assert blocks["terms"].nbytes + blocks["held"].nbytes < 0.6 * terms


def test_copies_share_one_result(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma")], SCHEMA)
    df = kw.memoize_by_text(docs, lambda d: kw.keywords(d, stop_words=[]))
    assert sorted((r.doc_id, r.term) for r in df.collect()) == [(1, "alpha"), (1, "beta"), (2, "alpha"), (2, "beta"), (3, "gamma")]
    assert "posexplode" in _plan(df)
