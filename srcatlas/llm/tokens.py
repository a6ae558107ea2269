"""Token ids of whole texts, each distinct chunk of a task encoded once."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cut between two of these chunks lies before one space that stands between
#: two non-space characters. None of the supported pre-tokenizers has a token
#: over such a place, so ids of chunks concatenate to the ids of the text.
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
#: Distinct chunks a Python worker remembers; further ones are encoded once a
#: batch. It changes the time taken only.
MEMO_CHUNKS = 600_000
#: Chunks longer than this are encoded each time, not remembered.
MEMO_CHARS = 64


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _encoder(path: str) -> Callable[[list[str]], list]:
    """A function from chunks to their ids (a list or array each)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda chunks: [enc.encode_ordinary(c) for c in chunks]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    def plain(chunks):
        return [e.ids for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]

    mark = _mark(tok)
    if mark is None:
        return plain
    glue, mark_id = mark

    def joined(chunks):
        """Many chunks as one text with a mark between them: one call's
        fixed cost is shared. Chunks that hold the mark or end in white
        space are encoded alone."""
        out: list = [None] * len(chunks)
        alone = [i for i, c in enumerate(chunks) if not c or c[-1].isspace() or _MARK in c]
        for i, ids in zip(alone, plain([chunks[i] for i in alone])):
            out[i] = ids
        rest = [i for i in range(len(chunks)) if out[i] is None]
        groups = [rest[k:k + _GLUED] for k in range(0, len(rest), _GLUED)]
        for group, ids in zip(groups, plain([glue.join(chunks[i] for i in g) for g in groups])):
            ids = np.array(ids, np.uint32)
            at = np.flatnonzero(ids == mark_id)
            lo = np.concatenate([[0], at + 1])
            hi = np.append(at, len(ids))
            if len(lo) != len(group):
                raise ValueError("the mark was not kept apart")
            for i, a, b in zip(group, lo, hi):
                out[i] = ids[a:b]
        return out

    return joined


_MARK, _MARK_SYMBOL, _GLUED = "\x01", "\u0101", 100


def _mark(tok):
    """How to join chunks: the text between two of them and its one id, or
    None where some longer vocabulary entry holds the mark's byte."""
    holding = [v for v in tok.get_vocab() if _MARK_SYMBOL in v and v not in (_MARK_SYMBOL, _MARK_SYMBOL + "</w>")]
    if holding:
        return None
    word_ends = _MARK_SYMBOL + "</w>" in tok.get_vocab()
    glue = f" {_MARK} " if word_ends else _MARK
    ids = tok.encode(_MARK, add_special_tokens=False).ids
    return (glue, ids[0]) if len(ids) == 1 else None


class _Memo(dict):
    """Chunk -> number; unknown chunks are numbered and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk):
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


def _edged(chunk: str) -> bool:
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()


class Encoder:
    """Ids of texts by a tokenizer file, exact, in bounded memory.

    Chunks are kept with the space before them left off; the first chunk of
    a text has none and is encoded by itself. Each distinct chunk of a batch
    is looked up once."""

    def __init__(self, path: str):
        self._encode = _encoder(path)
        self._memo = _Memo()
        self._ids = np.zeros(1 << 16, np.uint32)
        self._starts = np.zeros(1 << 14, np.int64)
        self._lens = np.zeros(1 << 14, np.int64)
        self._odd = np.zeros(1 << 14, bool)
        self._used = 0

    def _append(self, found: list) -> tuple[np.ndarray, np.ndarray]:
        """Store ids of chunks; their starts and lengths."""
        lens = np.fromiter(map(len, found), np.int64, len(found))
        total = int(lens.sum())
        while self._used + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        if total:
            self._ids[self._used:self._used + total] = np.concatenate([np.asarray(f, np.uint32) for f in found])
        starts = self._used + np.cumsum(lens) - lens
        self._used += total
        return starts, lens

    def _learn(self) -> None:
        """Encode the new chunks."""
        memo, new = self._memo, self._memo.new
        if not new:
            return
        first = len(memo) - len(new)
        while len(memo) > len(self._starts):
            for name in ("_starts", "_lens", "_odd"):
                now = getattr(self, name)
                setattr(self, name, np.concatenate([now, np.zeros_like(now)]))
        self._starts[first:len(memo)], self._lens[first:len(memo)] = self._append(self._encode([" " + c for c in new]))
        self._odd[first:len(memo)] = [_edged(c) for c in new]
        memo.new = []

    def _trim(self) -> None:
        """Forget the chunks past the first MEMO_CHUNKS, and all long ones."""
        memo = self._memo
        if len(memo) > MEMO_CHUNKS:
            for c in list(islice(memo, MEMO_CHUNKS, None)):
                del memo[c]
        n = len(memo)
        self._used = int(self._starts[n - 1] + self._lens[n - 1]) if n else 0

    def ids(self, text: str | None) -> np.ndarray:
        return next(self.batch([text]))

    def batch(self, texts) -> Iterator[np.ndarray]:
        """uint32 ids of each text in turn (null or empty: none); ``texts`` is
        an Arrow string column or a list."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        self._trim()
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        short = [c for c in distinct if len(c) <= MEMO_CHARS]
        numbers = np.fromiter(map(self._memo.__getitem__, short), np.int64, len(short))
        self._learn()
        if len(short) == len(distinct):
            starts, lens, odd = self._starts[numbers], self._lens[numbers], self._odd[numbers]
        else:
            is_short = np.fromiter((len(c) <= MEMO_CHARS for c in distinct), bool, len(distinct))
            long = [c for c in distinct if len(c) > MEMO_CHARS]
            starts, lens, odd = (np.zeros(len(distinct), t) for t in (np.int64, np.int64, bool))
            starts[is_short], lens[is_short], odd[is_short] = self._starts[numbers], self._lens[numbers], self._odd[numbers]
            starts[~is_short], lens[~is_short] = self._append(self._encode([" " + c for c in long]))
            odd[~is_short] = [_edged(c) for c in long]
        # some space is not between two non-space characters: cut elsewhere
        odd_before = np.concatenate([[0], np.cumsum(odd[which])])
        n_ids = lens[which]
        before = np.concatenate([[0], np.cumsum(n_ids)])
        at = np.repeat(starts[which] - before[:-1], n_ids)
        at += np.arange(len(at))
        every = self._ids[at]
        heads = iter(self._encode([distinct[which[a]] for a in edges[:-1]]))
        for i, (a, b) in enumerate(pairwise(edges.tolist())):
            head = next(heads)
            if odd_before[b] > odd_before[a]:
                yield self._cut_again(texts[i].as_py())
            else:
                yield np.concatenate([np.asarray(head, np.uint32), every[before[a + 1]:before[b]]])

    def _cut_again(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        head, *rest = _CUT.split(text)
        return np.concatenate([np.asarray(f, np.uint32) for f in self._encode([head, *[" " + c for c in rest]])])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()) & 0xFFFFFFFF
