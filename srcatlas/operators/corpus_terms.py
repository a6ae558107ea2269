"""Terms of a part of the corpus and their document frequencies, as packed blocks.

A part's distinct terms (words and pairs of neighbouring words) are numbered
in the order of their strings and dealt to blocks by a hash of their words. A
block goes out once, as compressed text with the number of the part's
documents that hold each term; what comes back are the document frequencies
alone, in the order of the block's terms. Both passes over a part number its
terms anew from the same words, so a term crosses the network once, whatever
number of documents has it, and no row is made for it.

``rows`` tables have (_part, doc_id, words): the words of a text, joined by
spaces (no word has one). Several rows may share an id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Buckets that the pairs of one first word are dealt to: few, as pairs of a
#: first word compress well together; more than one, for very common words.
SPREAD = 4
#: Blocks whose terms a task holds as text at a time.
TOGETHER = 32
#: From here on a pair of words and a document do not fit one number.
TOO_MANY = 1 << 63
BLOCKS = "_part int, _bucket int, terms binary, held binary"
FREQUENCIES = "_part int, _bucket int, df binary"


def _zip(data) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _packed(numbers: np.ndarray) -> bytes:
    """The count and the compressed bytes of whole numbers."""
    return len(numbers).to_bytes(8, "little") + _zip(numbers.astype("<i8").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(memoryview(data)[8:], 8 * n, codec="zstd", asbytes=True), "<i8")


class PartTerms:
    """Distinct terms of a part: ``doc``, ``term`` and ``n`` of each pair of
    document and term, by term and then by document; terms are numbered in
    the (binary) order of their strings. There is a word at least."""

    def __init__(self, rows: pa.Table, buckets: int):
        ids = rows.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        self.ids = ids.dictionary
        lists = pc.split_pattern(pa.concat_arrays(rows.column("words").cast(pa.large_string()).chunks), " ")
        lengths = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        del lists
        order = pc.sort_indices(coded.dictionary)
        self.words = coded.dictionary.take(order)
        rank = np.empty(len(order), "i4")
        rank[order.to_numpy()] = np.arange(len(order), dtype="i4")
        word = rank[coded.indices.to_numpy()]
        del coded, order, rank
        row = np.repeat(np.arange(len(lengths), dtype="i4"), lengths)
        doc = ids.indices.to_numpy().astype("i4")[row]
        pair = np.flatnonzero(row[1:] == row[:-1]).astype("i4")
        del row
        # a pair's string stands after its first word's and before any other
        # word's: a space is less than every character of a word
        self._base = len(self.words) + 1
        codes = np.empty(len(word) + len(pair), "i8")
        one, two = codes[:len(word)], codes[len(word):]
        np.multiply(word, self._base, out=one, dtype="i8")
        np.add(one[pair], word[pair + 1], out=two)
        two += 1
        del word
        found = None
        if self._base ** 2 * len(self.ids) >= TOO_MANY:
            found, codes[:] = np.unique(codes, return_inverse=True)
        codes *= len(self.ids)
        one += doc
        two += doc[pair]
        del pair, doc, one, two
        codes.sort()
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.n = np.diff(new, append=len(codes)).astype("i4")
        codes = codes[new]
        del new
        self.doc = (codes % len(self.ids)).astype("i4")
        codes //= len(self.ids)
        first = np.concatenate([[True], codes[1:] != codes[:-1]])
        self.term = np.cumsum(first, dtype="i4") - np.int32(1)
        self.codes = codes[first] if found is None else found
        del codes, first
        self._deal(buckets)

    def _deal(self, buckets: int) -> None:
        """``order``: the terms by bucket; bucket b has order[ends[b]:ends[b + 1]]."""
        hashes = np.fromiter((zlib.crc32(w) for w in self.words.cast(pa.large_binary()).to_pylist()), "u8", len(self.words))
        first, second = np.divmod(self.codes, self._base)
        spread = np.where(second > 0, hashes[second - 1] % SPREAD, 0)
        mixed = (hashes[first] * np.uint64(SPREAD) + spread.astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype("i8")
        self.order = np.argsort(bucket, kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])

    def strings(self, terms: np.ndarray) -> pa.Array:
        first, second = np.divmod(self.codes[terms], self._base)
        one = self.words.take(pa.array(first))
        two = self.words.take(pa.array(np.maximum(second - 1, 0)))
        return pc.if_else(pa.array(second > 0), pc.binary_join_element_wise(one, two, pa.scalar(" ", pa.large_string())), one)


def _worded(rows: pa.Table) -> pa.Table:
    """The rows that have a word. (In the plan, this would tokenise once more.)"""
    return rows.filter(pc.not_equal(rows.column("words"), ""))


def blocks_of(buckets: int):
    """A part's distinct terms, and in how many of its documents each is."""
    def run(rows: pa.Table) -> pa.Table:
        rows = _worded(rows)
        if not len(rows):
            return pa.table({"_part": pa.array([], pa.int32()), "_bucket": pa.array([], pa.int32()),
                             "terms": pa.array([], pa.binary()), "held": pa.array([], pa.binary())})
        part = PartTerms(rows, buckets)
        held = np.bincount(part.term)[part.order]
        out = []
        for low in range(0, buckets, TOGETHER):
            ends = part.ends[low:low + TOGETHER + 1]
            strings = part.strings(part.order[ends[0]:ends[-1]])
            ended = pc.binary_join_element_wise(strings, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
            _, offsets, data = ended.buffers()
            at = np.frombuffer(offsets, "i8", len(ended) + 1, 8 * ended.offset)[ends - ends[0]].tolist() if len(ended) else []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                text = data[at[b]:at[b + 1]]
                out.append((low + b, len(text).to_bytes(8, "little") + _zip(text), _packed(held[ends[b]:ends[b + 1]])))
        bucket, terms, counts = zip(*out)
        return pa.table({"_part": rows.column("_part").slice(0, 1).take([0] * len(out)), "_bucket": pa.array(bucket, pa.int32()),
                         "terms": pa.array(terms, pa.binary()), "held": pa.array(counts, pa.binary())})
    return run


def frequencies(blocks: pa.Table) -> pa.Table:
    """The document frequencies of a bucket's terms, for each part's block."""
    texts = []
    for x in blocks.column("terms"):
        data = x.as_buffer()
        texts.append(pa.decompress(data[8:], int.from_bytes(data[:8].to_pybytes(), "little"), codec="zstd", asbytes=True))
    held = [_unpacked(x.as_py()) for x in blocks.column("held")]
    data = b"".join(texts)
    del texts
    ends = np.flatnonzero(np.frombuffer(data, "u1") == ord("\n")) + 1
    at = np.concatenate([[0], ends]).astype("i8")
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data)])
    code = terms.dictionary_encode().indices.to_numpy()
    total = np.zeros(int(code.max()) + 1, "i8")
    np.add.at(total, code, np.concatenate(held))
    df = np.split(total[code], np.cumsum([len(x) for x in held])[:-1])
    return pa.table({"_part": blocks.column("_part"), "_bucket": blocks.column("_bucket"),
                     "df": pa.array([_packed(x) for x in df], pa.binary())})


def best_of(buckets: int, top_n: int):
    """A part's top terms by document, given the frequencies of its terms
    (with ``_docs``, the number of all documents)."""
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = _worded(rows)
        if not len(rows):
            return pa.table({"doc_id": rows.column("doc_id"), "term": pa.array([], pa.string()),
                             "score": pa.array([], pa.float64()), "rank": pa.array([], pa.int32())})
        part = PartTerms(rows, buckets)
        df = np.zeros(len(part.codes), "i8")
        for b, x in zip(known.column("_bucket").to_pylist(), known.column("df")):
            df[part.order[part.ends[b]:part.ends[b + 1]]] = _unpacked(x.as_py())
        n_docs = known.column("_docs")[0].as_py()
        # minus the weight: the order is stable, so equal weights of a document
        # stay in the order of their strings
        less = part.n * -(np.log((1 + n_docs) / (1 + df)) + 1)[part.term]
        norm = np.sqrt(np.bincount(part.doc, less * less, minlength=len(part.ids)))
        best = np.lexsort((less, part.doc))
        starts = np.concatenate([[0], np.cumsum(np.bincount(part.doc, minlength=len(part.ids)))])
        held = np.minimum(np.diff(starts), top_n)
        rank = np.concatenate([np.arange(n) for n in held])
        doc = np.repeat(np.arange(len(held)), held)
        best = best[starts[doc] + rank]
        return pa.table({"doc_id": part.ids.take(pa.array(doc)), "term": part.strings(part.term[best]).cast(pa.string()),
                         "score": pa.array(-less[best] / norm[doc]), "rank": pa.array(rank + 1, pa.int32())})
    return run
