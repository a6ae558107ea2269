import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases
from srcatlas.llm import common, tokens

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"]
HARD = [None, "", " ", "   ", " a", "a ", "a  b", "a b", "don't  stop\n\n foo \t bar", "x́ é é", "Σας ΣΑΣ",
        "<|endoftext|> a", "a" * 500 + " b", "1 2 33 4444", "a  b", "a \x1c", "a\x01 b \x01 c.", "Hi, you.\nThe x!\n", " end. ", "a\x85b c"]


def plain(path):
    if path.endswith(".tiktoken"):
        return lambda texts: tokens._encoder(path)(texts)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name):
    path = tokens.vocabulary_path(name)
    e, ref = tokens.Encoder(path), plain(path)
    texts = HARD + [t for _, t in cases.DOCS] + HARD
    got = list(e.batch(pa.array(texts, pa.string())))
    want = ref([t or "" for t in texts])
    assert [list(g) for g in got] == [list(w) for w in want]


@pytest.mark.parametrize("name", FILES[:2])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabcDE'.,!é́ç漢1\x01 ", max_size=40), max_size=5))
def test_encoder_on_any_text(name, texts):
    path = tokens.vocabulary_path(name)
    want = plain(path)(texts)
    assert [list(g) for g in tokens.encoder(path).batch(texts)] == [list(w) for w in want]


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 5)
    path = tokens.vocabulary_path(FILES[1])
    e, ref = tokens.Encoder(path), plain(path)
    for i in range(4):
        text = " ".join(f"w{i}{j}" for j in range(20))
        assert list(e.ids(text)) == list(ref([text])[0])
    e._trim()
    assert len(e._memo) == 5


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \nabAZé漢\x0b\x1c", max_size=30)), max_size=6))
def test_words_and_hashes(texts):
    raw, off = common.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = common.word_bounds(raw, off)
    hashes = common.hash_words(raw, starts, ends)
    got = [[bytes(raw[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [cases.words(t) for t in texts]
    flat = [w for ws in got for w in ws]
    by_word = {}
    for w, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_hash_in_slices(monkeypatch):
    raw, off = common.text_bytes(pa.array([cases.PROSE * 3 + " " + "y" * 100], pa.string()))
    starts, ends, _ = common.word_bounds(raw, off)
    whole = common.hash_words(raw, starts, ends)
    monkeypatch.setattr(common, "_SLICE", 16)
    assert (common.hash_words(raw, starts, ends) == whole).all()


def test_prefix_scan_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, int(rng.integers(0, 9)), None if rng.random() < .6 else i * 10) for k, n in (("a", 57), ("b", 1), ("c", 16)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long, w long")
    got = {(r.k, r.i): (r.s, r.l) for r in common.exclusive_prefix(df, ["k"], "i", {"s": "v"}, {"l": "w"}, block=8).collect()}
    for k, i, _, _ in rows:
        before = [r for r in rows if r[0] == k and r[1] < i]
        last = [r[3] for r in before if r[3] is not None]
        assert got[k, i] == (sum(r[2] for r in before), last[-1] if last else None)
