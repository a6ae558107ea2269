"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Similar documents are put into groups of
bounded size; a sparse matrix holds which shingles each group's union has.
The overlap of a query group with another group's union bounds the overlap of
any two of their documents, and only pairs of groups whose bound reaches the
threshold are opened and compared, document by document, exactly.

Steps (links are exact; the first steps only save work):

1. Documents with equal sets form a class; one of them stands for it.
2. Buckets of equal min-hashes propose stars (the bucket's smallest document
   and every other one); pairs are compared exactly, links give components.
3. Similar documents (a component's, or those that share a large bucket) are
   cut by size into groups of ``GROUP`` documents on average. A document's row of the matrix needs its rarest shingles only: two
   documents that link share a shingle among the ``prefix`` rarest of either,
   and of a document's prefix all but ``n - overlap`` shingles stand in the
   other one. Rarity is the count of a shingle's bucket among ``BUCKETS``;
   any fixed order is right, so nothing depends on the counts being exact.
4. Matrix entries that two groups share are counted, unless both are of one
   component. Where the count reaches the bound, the two groups are opened, as
   is each group of several components by itself: all overlaps of a block are
   one product of membership matrices.
5. Components of both kinds of links are the result.
6. Links lie within components, so ``linked_documents`` counts them there.
   A component that fits into one group is one block. Of a larger one, each
   group is stored once, as its union and its documents' places in it; two
   groups of like sizes meet in a block, the union bounds each query, and the
   rest is one matrix product. Classes carry their number of documents, so
   copies are never compared.

Copies never meet pairwise: a hot group of copies is one class, one of near
copies a few groups of one component.

Defined results: a null text, or one without words, has no shingles and links
with nothing; fewer words than a shingle make one shingle; repeated rows are
one document with equal sets; rows that share a ``doc_id`` are one document
and share its component, and each counts its own text's links, with every
other such row; a null ``doc_id`` links with nothing and has a null component
and no links; ties are broken by the smaller ``doc_id``; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, gram_hashes, hash_words, map_batches, mix64, pack, stored, text_bytes, unpack, word_bounds

SHINGLE_WORDS = 4
#: Two documents link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Most documents of a group.
GROUP = 64
#: Room of a group of which links are counted, and what a document takes of it
#: besides its shingles: 512 documents or a million shingles.
LINK_ROOM, LINK_ROW = 1 << 20, 1 << 11
#: Buckets of the rarity counts: the only thing broadcast, 4 bytes each.
BUCKETS = 1 << 22
#: Min-hash keys of a document (each of two hashes) that propose stars.
BANDS = 6
#: Buckets of document ids by which rows without any candidate are left out
#: before a join: at most this many numbers are broadcast.
ID_BUCKETS = 1 << 19

_SEEDS = mix64(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))


def shingle_sets(texts, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    raw, off = text_bytes(texts)
    starts, ends, first = word_bounds(raw, off)
    words = hash_words(raw, starts, ends)
    for a, b in zip(first[:-1], first[1:]):
        w = words[a:b]
        if len(w) >= k:
            yield np.unique(gram_hashes(w, k))
        elif len(w):
            yield gram_hashes(w, len(w)) ^ np.uint64(len(w))
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Rarest shingles among which a linked document shares one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int64)


def rarity(docs: DataFrame) -> np.ndarray:
    """How many documents' shingles fall into each bucket, over all rows."""
    parts = 16
    width = BUCKETS // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            got = [_bucket(s) for s in shingle_sets(b.column(0))]
            if got:
                total += np.bincount(np.concatenate(got), minlength=BUCKETS)
        if total.any():
            yield [range(parts), [pack(total[i * width:(i + 1) * width].astype("<u4")) for i in range(parts)]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + unpack(counts, "<u4").astype(np.int64)
        if sums:
            yield [list(sums), [pack(np.minimum(v, 0xFFFFFFFF).astype("<u4")) for v in sums.values()]]

    ddl = "part int, counts binary"
    summed = map_batches(map_batches(docs.select("text"), ddl, count).repartition(parts, "part"), ddl, add)
    out = np.zeros(BUCKETS, "<u4")
    for r in summed.collect():
        out[r["part"] * width:(r["part"] + 1) * width] = unpack(r["counts"], "<u4")
    return out


SIGNATURES = "doc_id long, n long, f1 long, f2 long, bands array<long>, prefix array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Of each row: set size, a 128-bit fingerprint of the set, min-hash keys
    and the prefix of its rarest shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        counts = shared.value
        for b in batches:
            n, f1, f2, bands, prefix = [], [], [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                one, two = _fingerprint(s)
                f1.append(one)
                f2.append(two)
                if not len(s):
                    bands.append([])
                    prefix.append([])
                    continue
                low = np.array([mix64(s ^ seed).min() for seed in _SEEDS])
                bands.append(_long(mix64(low[::2] * np.uint64(31) + low[1::2])))
                order = np.lexsort((s, counts[_bucket(s)]))[:prefix_length(len(s))]
                prefix.append(_long(s[order]))
            yield [b.column(0), n, f1, f2, bands, prefix]

    return stored(map_batches(docs.select("doc_id", "text"), SIGNATURES, run), "signatures")


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that name a set."""
    if not len(s):
        return 0, 0
    return int(_long(mix64(s).sum(keepdims=True))[0]), int(_long(np.bitwise_xor.reduce(mix64(s ^ _SEEDS[0]), keepdims=True))[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its smallest node) for every node of ``edges``
    (a, b): smallest neighbour and pointer jumping by turns until nothing
    changes; each round is written, so the plan stays short."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("component").alias("near"))
        step = stored(label.join(near, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("before")), "labels")
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = stored(step.join(up, "component").select("node", F.col("up").alias("component"), "before"), "labels")
        if label.where("component <> before").isEmpty():
            return label.select("node", "component")
        label = label.select("node", "component")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id's bucket holds an id of ``ids``."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS)).cast("int")
    wanted = ids.select(bucket(F.col("doc_id").cast("long")).alias("__b")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__b", bucket(F.col("doc_id"))).join(
        F.broadcast(wanted), "__b", "left_semi").drop("__b")


def _opened(blocks: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Open blocks (k1, k2, side, unit, doc_id): compare the documents of side
    0 (the queries) with those of side 1 (the group), or all of side 0 where
    there is no side 1. Returns links (a, b), enough to join every two units
    (components) that some link joins."""
    def run(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_numpy()
        links = block_links(list(shingle_sets(table.column("text"))), sides, table.column("doc_id").to_pylist(),
                            table.column("unit").to_pylist(), percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()),
                         "b": pa.array([b for _, b in links], pa.int64())})

    blocks = stored(blocks, "blocks")
    bounded_batches(docs.sparkSession)
    # merged whatever the size: the blocks grow with the documents
    full = _texts_of(docs, blocks).join(blocks.hint("merge"), "doc_id").select("k1", "k2", "side", "unit", "doc_id", "text")
    return stored(full.groupBy("k1", "k2").applyInArrow(run, "a long, b long"), "links")


def block_links(sets: list[np.ndarray], sides: np.ndarray, ids: list[int], units: list[int], percent: int) -> list[tuple[int, int]]:
    """Links of one block that join units not joined before."""
    q = [i for i in range(len(ids)) if sides[i] == 0 and len(sets[i])]
    g = [i for i in range(len(ids)) if sides[i] == 1 and len(sets[i])] if 1 in sides else q
    if not q or not g:
        return []
    nq, ng = np.array([len(sets[i]) for i in q]), np.array([len(sets[i]) for i in g])
    # the union of the group bounds each query
    union = np.unique(np.concatenate([sets[i] for i in g]))
    within = np.array([np.isin(sets[i], union, assume_unique=True, kind="sort").sum() for i in q])
    reach = np.flatnonzero(within >= _least(nq, ng, percent))
    if not len(reach):
        return []
    q, nq = [q[i] for i in reach], nq[reach]
    both = overlaps([sets[i] for i in q], [sets[i] for i in g])
    linked = 100 * both >= percent * (nq[:, None] + ng[None, :] - both)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = find(units[q[i]]), find(units[g[j]])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[q[i]], ids[g[j]]))
    return out


def _least(nq: np.ndarray, ng: np.ndarray, percent: int) -> np.ndarray:
    """Overlap that each query needs with the smallest it may link with."""
    smallest = np.maximum(ng.min(), -(-percent * nq // 100))
    return -(-percent * (nq + smallest) // (100 + percent))


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections, as products of membership matrices over
    slices of the shingles that both sides have."""
    a, b = np.concatenate(rows), np.concatenate(cols)
    ra, rb = np.repeat(np.arange(len(rows)), list(map(len, rows))), np.repeat(np.arange(len(cols)), list(map(len, cols)))
    shared = np.intersect1d(a, b)
    out = np.zeros((len(rows), len(cols)), np.int64)
    ia, ib = (np.searchsorted(shared, x) for x in (a, b))
    ka, kb = (np.flatnonzero((i < len(shared)) & (shared[np.minimum(i, len(shared) - 1)] == x)) if len(shared) else np.zeros(0, int)
              for i, x in ((ia, a), (ib, b)))
    ia, ra, ib, rb = ia[ka], ra[ka], ib[kb], rb[kb]
    oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
    ia, ra, ib, rb = ia[oa], ra[oa], ib[ob], rb[ob]
    for lo in range(0, len(shared), chunk):
        x, y = np.zeros((len(rows), chunk), np.float32), np.zeros((len(cols), chunk), np.float32)
        sa = slice(*np.searchsorted(ia, (lo, lo + chunk)))
        sb = slice(*np.searchsorted(ib, (lo, lo + chunk)))
        x[ra[sa], ia[sa] - lo] = 1
        y[rb[sb], ib[sb] - lo] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _buckets(reps: DataFrame) -> DataFrame:
    """(doc_id, leader, size) for each min-hash bucket of more than one
    document that a document is in; the leader is its smallest document."""
    keyed = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    leader = keyed.groupBy("band", "key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    return stored(keyed.join(stored(leader, "leaders").hint("merge"), ["band", "key"]).select("doc_id", "leader", "size"), "buckets")


def _star_blocks(buckets: DataFrame) -> DataFrame:
    """Blocks of a bucket's smallest document and up to GROUP others."""
    pairs = stored(buckets.where("doc_id <> leader").select("leader", "doc_id").distinct(), "stars")
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = pairs.join(stored(sizes, "star-sizes"), "leader").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    block = (F.col("leader").alias("k1"), F.col("part").alias("k2"))
    return dealt.select(*block, F.lit(1).alias("side"), F.col("doc_id").alias("unit"), "doc_id").unionByName(
        dealt.select(*block, F.lit(0).alias("side"), F.col("leader").alias("unit"), F.col("leader").alias("doc_id")).distinct())


def _grouped(reps: DataFrame, comp: DataFrame, buckets: DataFrame) -> DataFrame:
    """(doc_id, component, group, unit, lo, hi): similar documents in groups
    (named by their smallest document) whose sizes run from lo to hi.

    A component's documents go together, and so do the other documents whose
    largest bucket has the same leader: they are alike, though not linked.
    ``unit`` is the component where a group has one only, else the group."""
    family = buckets.groupBy("doc_id").agg(F.max(F.struct("size", -F.col("leader"))).alias("top")).select(
        "doc_id", (-F.col("top.col2")).alias("family"))
    d = reps.select("doc_id", "n").join(family, "doc_id", "left").join(
        comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    d = stored(d.select(
        "doc_id", "n", F.coalesce("component", "doc_id").alias("component"), F.col("component").isNotNull().alias("joined"),
        F.coalesce("component", "family", "doc_id").alias("family"),
        # sizes that may link lie close together
        F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(PERCENT / 100))).alias("scale")), "grouped")
    keys = ["family", "joined", "scale"]
    sizes = d.groupBy(*keys).agg(F.ceil(F.count("*") / GROUP).alias("parts")).where("parts > 1")
    cut = d.join(stored(sizes, "family-sizes"), keys, "left").withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))))
    named = cut.groupBy(*keys, "part").agg(
        F.min("doc_id").alias("group"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("size"))
    return stored(cut.join(stored(named, "group-names"), [*keys, "part"]).select(
        "doc_id", "component", "group", F.when(F.col("joined"), F.col("component")).otherwise(F.col("group")).alias("unit"),
        "lo", "hi", "size"), "groups")


def _need(hi: Column, lo_other: Column) -> Column:
    """Matrix entries that a query of at most ``hi`` shingles must share with
    a group of at least ``lo_other`` if one of its documents links: of the
    query's prefix all but n - overlap. Falls with the query's size, so the
    largest size gives the bound of a query group."""
    t = PERCENT / 100
    real = F.greatest(lo_other.cast("double"), hi * t) * (t / (1 + t)) + hi * (t / (1 + t) - t)
    return F.greatest(F.lit(1).cast("long"), F.ceil(real - 1e-6))


def _candidate_groups(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of groups (group1, group2) of different units whose shared matrix
    entries reach the bound, and groups of several documents with themselves."""
    # a unit that is the group itself is left null: less to shuffle
    named = groups.select("doc_id", "group", F.when(F.col("unit") != F.col("group"), F.col("unit")).alias("unit"))
    entries = signed.where("n > 0").select("doc_id", "prefix").join(named.hint("merge"), "doc_id").select(
        "group", "unit", F.explode("prefix").alias("token"))
    # a shingle that one unit has only cannot join two; one shuffle by
    # shingle finds and keeps the others
    unit, of = F.coalesce("unit", "group"), Window.partitionBy("token")
    shared_by = entries.select("token", "group", F.min(unit).over(of).alias("u0"), F.max(unit).over(of).alias("u1")).where("u0 <> u1")
    sizes = stored(groups.select("group", "unit", "lo", "hi", "size").distinct(), "group-sizes")
    matrix = stored(shared_by.select("token", "group").distinct(), "matrix")
    matrix = stored(matrix.join(sizes.select("group", "unit", "lo", "hi"), "group"), "matrix")
    side = lambda i: matrix.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("group", "unit", "lo", "hi")])
    met = side(1).join(side(2), "token").where(
        "group1 < group2 and unit1 <> unit2"
        f" and 100 * hi2 >= {PERCENT} * lo1 and 100 * hi1 >= {PERCENT} * lo2")
    shared = met.groupBy("group1", "group2").agg(
        F.count("*").alias("shared"), *[F.first(c).alias(c) for c in ("lo1", "hi1", "lo2", "hi2")])
    pairs = shared.where(F.col("shared") >= F.least(
        _need(F.col("hi1"), F.col("lo2")), _need(F.col("hi2"), F.col("lo1")))).select("group1", "group2")
    mixed = sizes.where("unit = group and size > 1").select(F.col("group").alias("group1"), F.col("group").alias("group2"))
    return stored(pairs.unionByName(mixed), "candidates")


def _group_blocks(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    of = groups.select("doc_id", "group", F.col("component").alias("unit"))
    sides = [(pairs if side == 0 else pairs.where("group1 <> group2")).join(of.withColumnRenamed("group", g), g).select(
        F.col("group1").alias("k1"), F.col("group2").alias("k2"), F.lit(side).alias("side"), "unit", "doc_id")
        for side, g in enumerate(("group1", "group2"))]
    return sides[0].unionByName(sides[1])


def _shared_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of rows that share a doc_id."""
    twice = stored(known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "shared-ids")
    rows = known.join(twice, "doc_id", "left_semi").join(classes, ["n", "f1", "f2"])
    return rows.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()


def _linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's set (doc_id, n, f1, f2), and every class of equal sets
    (n, f1, f2, rep, copies, component_id)."""
    signed = signatures(docs)
    sets = signed.select("doc_id", "n", "f1", "f2")
    known = sets.where("n > 0 and doc_id is not null")
    classes = stored(known.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = stored(signed.where("n > 0").select("doc_id", "n", "f1", "f2", "bands").join(
        classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "n", "f1", "f2"], "left_semi").dropDuplicates(["doc_id", "n", "f1", "f2"]), "reps")
    buckets = _buckets(reps)
    edges = _opened(_star_blocks(buckets), docs).unionByName(_shared_ids(known, classes))
    groups = _grouped(reps, components(edges), buckets)
    links = _opened(_group_blocks(groups, _candidate_groups(signed, groups)), docs)
    comp = components(edges.unionByName(links))
    placed = stored(classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "f1", "f2", "rep", "copies", F.coalesce("component", "rep").alias("component_id")), "class-components")
    return sets, placed


#: Documents of a class: its key and how many they are.
CLASS = ("n", "f1", "f2", "copies")
PACKED = "component_id long, code long, tokens binary, places binary, n binary, f1 binary, f2 binary, copies binary"
COUNTED = "n long, f1 long, f2 long, others long"


def _class_rows(table: pa.Table) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """The set of each class of a group of (text, n, f1, f2, copies) rows,
    once, and its key: a row whose text is another class's is left out."""
    keys = {c: table.column(c).to_numpy() for c in CLASS}
    sets, rows, seen = [], [], set()
    for i, s in enumerate(shingle_sets(table.column("text"))):
        key = (len(s), *_fingerprint(s))
        if key == (keys["n"][i], keys["f1"][i], keys["f2"][i]) and key not in seen:
            seen.add(key)
            sets.append(s)
            rows.append(i)
    return sets, {c: v[rows] for c, v in keys.items()}


def linked_with(q: list[np.ndarray], q_copies: np.ndarray, g: list[np.ndarray], g_copies: np.ndarray,
                same: bool = False, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of ``q`` the number of documents of ``g`` that it links
    with, and of each of ``g`` those of ``q``; with ``same``, ``g`` is ``q``
    and no set links with itself."""
    to_q, to_g = np.zeros(len(q), np.int64), np.zeros(len(g), np.int64)
    if not q or not g:
        return to_q, to_g
    nq, ng = (np.array([len(s) for s in x]) for x in (q, g))
    if same:
        reach = np.arange(len(q))
    else:
        union = np.unique(np.concatenate(g))
        within = np.array([np.isin(s, union, assume_unique=True, kind="sort").sum() for s in q])
        reach = np.flatnonzero(within >= _least(nq, ng, percent))
    if len(reach):
        both = overlaps([q[i] for i in reach], g)
        linked = 100 * both >= percent * (nq[reach, None] + ng[None, :] - both)
        if same:
            np.fill_diagonal(linked, False)
        to_q[reach] = linked @ g_copies
        to_g = q_copies[reach] @ linked
    return to_q, to_g


def _counted(keys: dict[str, np.ndarray], others: np.ndarray) -> pa.Table:
    return pa.table({**{c: pa.array(keys[c], pa.int64()) for c in CLASS[:3]}, "others": pa.array(others, pa.int64())})


def _count_whole(table: pa.Table) -> pa.Table:
    sets, keys = _class_rows(table)
    return _counted(keys, linked_with(sets, keys["copies"], sets, keys["copies"], same=True)[0])


def _pack_group(table: pa.Table) -> pa.Table:
    """One row for a group: its union and each document's places in it."""
    sets, keys = _class_rows(table)
    tokens = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    places = np.searchsorted(tokens, np.concatenate(sets)) if sets else np.zeros(0, int)
    binary = {"tokens": pack(tokens.astype("<u8")), "places": pack(places.astype("<u4")),
              **{c: pack(keys[c].astype("<i8")) for c in CLASS}}
    row = {c: pa.array(table.column(c)[:1].to_pylist(), pa.int64()) for c in ("component_id", "code")}
    return pa.table(row | {c: pa.array([binary[c]], pa.binary()) for c in ("tokens", "places", *CLASS)})


def _count_block(table: pa.Table) -> pa.Table:
    sides = []
    for row in table.to_pylist():
        keys = {c: unpack(row[c], "<i8") for c in CLASS}
        ends = np.cumsum(keys["n"])[:-1]
        sides.append((np.split(unpack(row["tokens"], "<u8")[unpack(row["places"], "<u4")], ends) if len(keys["n"]) else [], keys))
    (q, a), (g, b) = sides[0], sides[-1]
    to_q, to_g = linked_with(q, a["copies"], g, b["copies"], same=len(sides) == 1)
    if len(sides) == 1:
        return _counted(a, to_q)
    return pa.concat_tables([_counted(a, to_q), _counted(b, to_g)])


def _links_of_classes(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """(n, f1, f2, others): how many documents of other classes a class links
    with, for the classes of components of several classes."""
    room = F.sum(F.col("n") + LINK_ROW)
    whole = stored(placed.groupBy("component_id").agg(F.count("*").alias("classes"), room.alias("room")).where("classes > 1"), "linked-sizes")
    # sets that may link lie in the same scale or the next; the hair more
    # keeps rounding from parting sizes of exactly 85 %
    scale = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(PERCENT / 100) * (1 + 1e-9)))
    linked = stored(placed.join(whole, "component_id").withColumn(
        "scale", F.when(F.col("room") > LINK_ROOM, scale)).drop("classes", "room"), "linked")
    parts = stored(linked.where("scale is not null").groupBy("component_id", "scale").agg(
        F.ceil(room / LINK_ROOM).alias("parts")), "linked-parts")
    code = lambda scale, part: F.shiftleft(F.col(scale), 32) + F.col(part)
    dealt = stored(linked.join(parts, ["component_id", "scale"], "left").withColumn(
        "part", F.pmod(F.xxhash64("f1"), F.col("parts"))).select(
        F.col("rep").alias("doc_id"), "component_id", *CLASS, code("scale", "part").alias("code")), "linked-groups")
    bounded_batches(docs.sparkSession)
    texts = stored(_texts_of(docs, dealt).join(dealt.hint("merge"), "doc_id").drop("doc_id"), "linked-texts")
    one = texts.where("code is null").groupBy("component_id").applyInArrow(_count_whole, COUNTED)
    groups = stored(texts.where("code is not null").groupBy("component_id", "code").applyInArrow(_pack_group, PACKED), "unions")
    near = parts.select("component_id", F.explode(F.sequence(F.col("scale") - 1, F.col("scale") + 1)).alias("scale"),
                        F.col("scale").alias("scale2"), "parts")
    met = groups.withColumn("scale", F.shiftright("code", 32)).join(near, ["component_id", "scale"]).withColumn(
        "part2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("code2", code("scale2", "part2"))
    blocks = met.withColumn("k1", F.least("code", "code2")).withColumn("k2", F.greatest("code", "code2")).select(
        "component_id", "k1", "k2", "tokens", "places", *CLASS)
    two = blocks.groupBy("component_id", "k1", "k2").applyInArrow(_count_block, COUNTED)
    return stored(one.unionByName(two).groupBy(*CLASS[:3]).agg(F.sum("others").alias("others")), "linked-counts")


def linked_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    sets, placed = _linked_classes(docs)
    return sets.join(placed.select("n", "f1", "f2", "component_id"), ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def linked_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs``;
    ``n_links`` is the number of other documents it links with directly."""
    sets, placed = _linked_classes(docs)
    others = _links_of_classes(docs, placed)
    of = placed.join(others, ["n", "f1", "f2"], "left").select(
        "n", "f1", "f2", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    named = F.col("doc_id").isNotNull()
    return sets.join(stored(of, "class-links"), ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(named, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.when(named, F.col("links")), F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a smaller
    ``doc_id``. Documents without shingles or without an id stay."""
    linked = linked_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__dropped")).distinct()
    dropped = stored(linked, "near-duplicates")
    return docs.join(dropped, docs["doc_id"] == dropped["__dropped"], "left_anti")
