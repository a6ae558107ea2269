"""Prefix trie of conversations by adaptive radix trees.

A turn (role, text) is a fixed-width id: 16 bytes of its SHA-256 and the
number of code points of its text, big-endian, in 4 bytes. A conversation is
the byte string of its turns' ids. Blocks of sorted byte strings go into
adaptive radix trees, whose nodes hold 4, 16, 48 or 256 children and grow from
one layout to the next, and whose single-child paths are compressed. Only byte
depths on a turn's edge are nodes of the result.

Blocks are cut anywhere in the sorted order, also within a prefix that all
conversations share: a block knows the last string before it and the first
one after it, and hands on what the nodes on its two edges have there. With
those neighbours every figure of a node is a sum (or minimum) over blocks:

- members: a sum of the strings' weights (equal conversations are one string);
- children, and the texts' lengths to subtract once a node: counted by the
  first string, in order, that has the child or the node;
- leaves: strings that the next string does not start with.

So nodes inside a block are final, and the edges' parts are added up by one
small aggregation. ``ends_sha256`` hashes ids in numeric order as a stream of
pieces of bounded size, so no list of a node's conversations is ever held.

Defined results: rows with a null ``conv_id`` belong to no conversation; a
null role or text is an empty one; turns are ordered by ``turn``, null first,
equal turn numbers by their turn id; repeated rows are turns of their own;
a conversation without rebuilt turns is a member of the root only; an empty
table has no nodes; other columns are not read. A conversation is one row of
20 bytes a turn while its string is made.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored, transposed

#: Bytes of a turn id.
WIDTH = 20
#: Strings and bytes of the strings of one tree.
BLOCK_KEYS = 1 << 14
BLOCK_BYTES = 16 << 20
#: Bytes of one piece of a list of ids.
PIECE = 1 << 20
#: Conversations of this many ids share their first turns with the first one.
FAMILY = 100
#: First turns taken over: a conversation's hash modulo this.
HEADS = 6

NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- the tree ---------------------------------------------------------------

class Few:
    """Up to ``room`` (4 or 16) children: sorted bytes and nodes beside them."""
    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        i = bisect_left(self.bytes, byte)
        return self.nodes[i] if i < len(self.bytes) and self.bytes[i] == byte else None

    def put(self, byte: int, node):
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.nodes[i] = node
            return self
        if len(self.bytes) == self.room:
            wider = Few(16) if self.room == 4 else Indexed()
            for b, n in zip(self.bytes, self.nodes):
                wider.put(b, n)
            return wider.put(byte, node)
        self.bytes.insert(i, byte)
        self.nodes.insert(i, node)
        return self

    def in_order(self) -> list:
        return self.nodes


class Indexed:
    """Up to 48 children: a place for each byte, and the nodes by place."""
    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, byte: int):
        at = self.places[byte]
        return None if at == 255 else self.nodes[at]

    def put(self, byte: int, node):
        at = self.places[byte]
        if at != 255:
            self.nodes[at] = node
        elif len(self.nodes) < 48:
            self.places[byte] = len(self.nodes)
            self.nodes.append(node)
        else:
            wider = Direct()
            for b in range(256):
                if self.places[b] != 255:
                    wider.nodes[b] = self.nodes[self.places[b]]
            return wider.put(byte, node)
        return self

    def in_order(self) -> list:
        return [self.nodes[at] for at in self.places if at != 255]


class Direct:
    """Any byte's child at the byte's own place."""
    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node):
        self.nodes[byte] = node
        return self

    def in_order(self) -> list:
        return [n for n in self.nodes if n is not None]


class Node:
    """A node at byte ``depth``; ``key`` is some string below it, of which
    bytes up to ``depth`` are the path. ``value`` is what ends here."""
    __slots__ = ("key", "depth", "value", "kids", "n", "low", "leaves", "heads", "saved")

    def __init__(self, key: bytes, depth: int, value=None):
        self.key, self.depth, self.value, self.kids = key, depth, value, None


def common_length(a: bytes, b: bytes, start: int = 0) -> int:
    """Bytes that two strings have in common, equal up to ``start``."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    lo, hi = start, end  # a[:lo] equal, a[:hi] not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class RadixTree:
    """Insert byte strings in any order; walk them in byte order."""

    def __init__(self):
        self.root = Node(b"", 0)

    def insert(self, key: bytes, value) -> None:
        node = self.root
        while True:
            if len(key) == node.depth:
                node.value = value
                return
            byte = key[node.depth]
            child = node.kids.get(byte) if node.kids is not None else None
            if child is None:
                node.kids = (node.kids if node.kids is not None else Few()).put(byte, Node(key, len(key), value))
                return
            # the child's path is compressed: compare all of it at once
            same = common_length(child.key[:child.depth], key, node.depth)
            if same < child.depth:
                split = Node(key, same)
                split.kids = Few().put(child.key[same], child)
                node.kids = node.kids.put(byte, split)
                child = split
            node = child

    def post_order(self) -> Iterator[Node]:
        stack = [(self.root, False)]
        while stack:
            node, seen = stack.pop()
            if seen or node.kids is None:
                yield node
            else:
                stack.append((node, True))
                stack += [(c, False) for c in node.kids.in_order()]


def _length(key: bytes, turn: int) -> int:
    """Code points of the text of turn ``turn`` (from 1)."""
    return int.from_bytes(key[turn * WIDTH - 4:turn * WIDTH], "big")


def block_nodes(keys: list[bytes], values: list[tuple], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """The result's nodes (NODES) that a block of sorted distinct strings has
    a part of; ``values``: (members, smallest member, hash of their ids).

    A node on an edge that the neighbouring string shares is a part only: it
    has an id, and its figures are to be added to its other parts'."""
    tree = RadixTree()
    for key, value in zip(keys, values):
        tree.insert(key, value)
    shared_left = -1 if before is None else common_length(before, keys[0]) // WIDTH
    shared_right = -1 if after is None else common_length(keys[-1], after) // WIDTH
    known = common_length(before, keys[0]) // WIDTH if before is not None else 0

    def kept(key: bytes, turn: int, n: int, left: bool) -> int:
        """n times the text's length, less once where it first occurs."""
        return (n - (0 if left and turn <= known else 1)) * _length(key, turn)

    # figures of the tree's nodes from below; left: does it hold the first string
    first = keys[0]
    for node in tree.post_order():
        kids = node.kids.in_order() if node.kids is not None else []
        edge = (node.depth // WIDTH + 1) * WIDTH
        node.n, node.low = (node.value[0], node.value[1]) if node.value else (0, None)
        node.heads = node.saved = 0
        ends_as_leaf = node.value is not None and not kids and not (after is not None and after.startswith(node.key))
        node.leaves = int(ends_as_leaf)
        for c in kids:
            node.n += c.n
            node.low = c.low if node.low is None else min(node.low, c.low)
            node.leaves += c.leaves
            node.heads += 1 if c.depth >= edge else c.heads
            left = c is kids[0] and first.startswith(c.key[:c.depth])
            node.saved += c.saved + sum(
                kept(c.key, t, c.n, left) for t in range(node.depth // WIDTH + 1, c.depth // WIDTH + 1))

    # emitted from above: (node, does its path hold the first, the last string, parent's id and conv_id)
    def identity(key: bytes, turn: int) -> bytes:
        return hashlib.sha256(key[:turn * WIDTH]).digest()

    def row(node: Node, turn: int, end: bool, left: bool, right: bool, saved: int, parent) -> tuple:
        part = (left and turn <= shared_left) or (right and turn <= shared_right)
        children = node.heads if end else 1
        if left and turn < known:
            children -= 1
        own = identity(node.key, turn) if part else None
        ends = node.value[2] if end and node.value else None
        pid, pconv = parent
        return own, pid, turn, node.low, (None if pid is not None else pconv), node.n, children, node.leaves, saved, ends

    root = tree.root
    out = row(root, 0, True, True, True, root.saved, (None, None))
    yield out
    stack = [(root, True, True, (out[0], root.low))]
    while stack:
        node, left, right, parent = stack.pop()
        kids = node.kids.in_order() if node.kids is not None else []
        begun = []
        for i, c in enumerate(kids):
            on_left = left and i == 0
            on_right = right and i == len(kids) - 1
            turns = range(node.depth // WIDTH + 1, c.depth // WIDTH + 1)
            saved, sums = c.saved, []
            for t in reversed(turns):
                saved += kept(c.key, t, c.n, on_left)
                sums.append(saved)
            above = parent
            for t, s in zip(turns, reversed(sums)):
                out = row(c, t, t * WIDTH == c.depth, on_left, on_right, s, above)
                yield out
                above = (out[0], c.low)
            begun.append((c, on_left, on_right, above))
        stack += reversed(begun)


# --- Spark ------------------------------------------------------------------

def head_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): of each conversation the ids of its turns in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    tid = F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text).cast("long")), 8, "0")))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), tid.alias("tid"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "tid"))).getField("tid").alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """(conv_id, key): each conversation's string, its first turns taken from
    the first conversation of its family of ids."""
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = lists.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("heads"))
    joined = lists.withColumn("family", family).join(heads, "family", "left").select("conv_id", "turns", "heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            ids, keys = b.column(0).to_pylist(), []
            for c, turns, heads in zip(ids, b.column(1).to_pylist(), b.column(2).to_pylist()):
                h = head_turns(c)
                keys.append(b"".join((heads or [])[:h] + turns[h:]))
            yield [ids, keys]

    return map_batches(joined, "conv_id long, key binary", run)


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


KEYS = "key binary, n long, low long, ends string"


def distinct_keys(convs: DataFrame) -> DataFrame:
    """(part, key, n, low, ends): each distinct string with its conversations'
    number, smallest id and hash of ids, ranged by ``key`` over ``part``."""
    n = _parts(convs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        now, ids, size = None, [], 0
        for b in batches:
            out = []
            for c, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (key != now or size > PIECE):
                    out.append((now, ids[0], len(ids), ",".join(map(str, ids))))
                    ids, size = [], 0
                now = key
                ids.append(c)
                size += 12
            yield transposed(out, 4)
        if ids:
            yield [[now], [ids[0]], [len(ids)], [",".join(map(str, ids))]]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        now, n, low, sha = None, 0, 0, None
        for b in batches:
            out = []
            for key, first, count, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                if sha is not None and key == now:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((now, n, low, sha.hexdigest()))
                    now, n, low, sha = key, 0, first, hashlib.sha256()
                n += count
                sha.update(ids.encode())
            yield transposed(out, 4)
        if sha is not None:
            yield [[now], [n], [low], [sha.hexdigest()]]

    # equal strings may be any share of all: cut by id as well, then put together
    spread = convs.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    cut = stored(map_batches(spread, "key binary, first long, count long, ids string", pieces), "id-pieces")
    whole = map_batches(cut.repartitionByRange(n, "key").sortWithinPartitions("key", "first"), KEYS, joined)
    return stored(whole.withColumn("part", F.spark_partition_id()), "keys")


def _neighbours(keys: DataFrame) -> DataFrame:
    """Rows that tell a part the string before its first (kind 0) and the one
    after its last (kind 2); as many as there are parts."""
    ends = keys.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    by = Window.orderBy("part")
    told = ends.select("part", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    side = lambda kind, c: told.where(F.col(c).isNotNull()).select(
        "part", F.lit(kind).alias("kind"), F.col(c).alias("key"), F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("low"), F.lit(None).cast("string").alias("ends"))
    return side(0, "before").unionByName(side(2, "after"))


NODES = ("node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, ends_sha256 string")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(keys, values, before, after) of blocks of bounded size, from rows in
    the order of (part, kind, key)."""
    part, before, keys, values, size = None, None, [], [], 0
    for b in batches:
        for p, kind, key, n, low, ends in zip(*(b.column(i).to_pylist() for i in range(6))):
            if p != part or kind == 2:
                if keys:
                    yield keys, values, before, key if p == part else None
                part, before, keys, values, size = p, None, [], [], 0
            if kind == 0:
                before = key
            elif kind == 1:
                if len(keys) >= BLOCK_KEYS or size >= BLOCK_BYTES:
                    yield keys, values, before, key
                    before, keys, values, size = keys[-1], [], [], 0
                keys.append(key)
                values.append((n, low, ends))
                size += len(key)
    if keys:
        yield keys, values, before, None


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    n = _parts(conversations.sparkSession)
    keys = distinct_keys(rebuilt(turn_lists(conversations)))
    rows = keys.select("part", F.lit(1).alias("kind"), "key", "n", "low", "ends").unionByName(_neighbours(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for block in _blocks(batches):
            out = []
            for row in block_nodes(*block):
                out.append(row)
                if len(out) == 4096:
                    yield transposed(out, 10)
                    out = []
            yield transposed(out, 10)

    dealt = rows.repartition(n, "part").sortWithinPartitions("part", "kind", "key")
    nodes = stored(map_batches(dealt, NODES, run), "trie-nodes")
    edges = stored(nodes.where("node is not null").groupBy("node").agg(
        F.first("parent", ignorenulls=True).alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256")), "trie-edges")
    every = nodes.where("node is null").unionByName(edges.withColumn("parent_conv_id", F.lit(None).cast("long")))
    parents = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("__parent_conv"))
    return every.join(parents, "parent", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "__parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


#: The same rows by grouping every prefix of every conversation; crc32 by its
#: table of 256 remainders.
SQL = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, s, place, v) AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR), 1, CAST(4294967295 AS BIGINT) FROM ids
  UNION ALL
  SELECT c.conv_id, c.s, c.place + 1, xor(t.v, c.v >> 8)
  FROM crc c JOIN bits t ON t.k = 8 AND t.i = xor(c.v, ascii(substr(c.s, c.place, 1))) & 255 WHERE c.place <= length(c.s)),
heads AS (SELECT conv_id, conv_id - conv_id % 100 AS family, xor(v, 4294967295) % 6 AS h FROM crc WHERE place = length(s) + 1),
own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT h.conv_id, o.d, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.family AND o.d <= h.h
  UNION ALL SELECT h.conv_id, o.d, o.role, o.text FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.d > h.h),
paths AS (
  SELECT h.conv_id, coalesce(list({'t': sha256(concat(length(t.role), ':', t.role, t.text)), 'n': length(t.text)} ORDER BY t.d)
                             FILTER (t.d IS NOT NULL), []) AS path
  FROM heads h LEFT JOIN turns t USING (conv_id) GROUP BY h.conv_id),
prefixes AS (
  SELECT conv_id, depth, len(path) AS whole, sha256(CAST(path[1:depth] AS VARCHAR)) AS node,
         CASE WHEN depth > 0 THEN sha256(CAST(path[1:depth - 1] AS VARCHAR)) END AS parent,
         CASE WHEN depth > 0 THEN path[depth].n ELSE 0 END AS size
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths)),
nodes AS (
  SELECT node, parent, depth, size, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = whole), '')) AS ends_sha256
  FROM prefixes GROUP BY node, parent, depth, size),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, CAST(sum((x.n_convs - 1) * x.size) AS BIGINT) AS saved_tokens
  FROM nodes x JOIN prefixes p ON p.conv_id = x.conv_id AND p.depth <= x.depth LEFT JOIN kids k ON k.node = x.node
  GROUP BY p.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves,
       b.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node
"""
