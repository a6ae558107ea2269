"""Near-duplicate vectors by NN-descent.

A neighbour graph is refined by joining the neighbours of every vector's
neighbours, until a round finds no further pair at the threshold and an audit
against brute force finds nearly all; the pairs at the threshold are the
result's links.

Steps on Spark:

1. Equal vectors of a label are one node, with the number of its ids.
2. Dense groups become balls. Nodes are dealt into cells by the signs of
   random projections, cells that are too full into parts by hash; in each, a
   node with ``BALL`` or more others within half of the threshold's angle
   becomes their pivot. Pivots are dealt again (other projections) until no
   cell is too full; members that are too far from the pivot their pivot has
   gone to are nodes of their own again. Any two members of a ball link, by the
   triangle inequality on the sphere, so a ball's links are counted, not
   listed: a group of copies of any size costs its members once.
3. Pivots and the other nodes get neighbour lists: the best of the cells of
   ``TREES`` projections, then NN-descent. Lists begin with ``NEAR`` places;
   a list that is full of pairs at the threshold is doubled. All pairs at the
   threshold that were ever seen are kept, whatever place they had. For balls
   the threshold is wider by both radii.
4. When a round brings nothing new, ``AUDIT`` nodes are compared with all
   others; below ``RECALL`` more projections and more rounds follow.
5. Pairs of balls are opened by members: a member whose distance from the
   other pivot settles all pairs is counted as a whole, the rest is compared
   in blocks of ``BLOCK`` members a side.

Links are never below the threshold; a pair may be missed with what the audit
measures (``audit``). Cosines are taken in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite
numbers, and rows with a null label or null ``vec_id``, link with nothing
(``component_id`` is ``vec_id``); vectors of different lengths do not link;
repeated rows are one vector; rows that share a ``vec_id`` with another label
or vector are vectors of their own; ties go to the smaller ``vec_id``; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, map_batches, stored
from .op07_token_groups import components

THRESHOLD = 0.93
#: Nodes of a cell: about so many, and in no part much more than that.
CELL = 192
#: Least members of a ball.
BALL = 32
#: Places of a neighbour list at first; projections that fill it.
NEAR = 8
TREES = 4
#: Members of one side of an opened pair of balls in one task.
BLOCK = 256
#: Nodes of the audit, the share of their pairs to be found, and the most
#: times that more projections are added.
AUDIT = 1024
RECALL = 0.97
TRIES = 4
#: Rounds of joins after each filling of lists, at most.
ROUNDS = 8
#: Rounds of pivots.
BALL_ROUNDS = 8
#: Number of the first projections that balls use; lists use those from 0.
BALL_TREES = 1 << 20
#: Signs of a cell's code.
BITS = 48
#: Radians by which bounds are kept on the safe side.
SLACK = 1e-6


def unit_rows(col) -> np.ndarray:
    """The vectors (all of one length) of a list column, scaled to length 1."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


# --- nodes ------------------------------------------------------------------

def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec, f1, f2) of the rows that may link."""
    vec = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), vec.alias("vec"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()).where(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0))
    return good.select("*", F.xxhash64("vec").alias("f1"), F.xxhash64(F.lit(1), F.col("vec")).alias("f2"))


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, label, dim, low, mult, vec, f1, f2): one for each distinct
    vector of a label, with its smallest id and the number of its ids."""
    key = ["label", "f1", "f2"]
    ids = rows.select(*key, "vec_id").distinct().groupBy(*key).agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    held = rows.groupBy(*key).agg(F.first("vec").alias("vec"))
    return stored(held.join(ids, key).select(
        F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("dim"), "low", "mult", "vec", "f1", "f2"), "nodes")


# --- cells ------------------------------------------------------------------

def _codes(vectors, lengths: np.ndarray, tree: int, cache: dict) -> np.ndarray:
    """Signs of the projections of one tree as a number, for each vector."""
    out = np.zeros(len(lengths), np.int64)
    for dim in np.unique(lengths):
        if (dim, tree) not in cache:
            cache[dim, tree] = np.random.default_rng([tree, int(dim)]).standard_normal((int(dim), BITS))
        at = np.flatnonzero(lengths == dim)
        x = unit_rows(vectors.take(pa.array(at)))
        out[at] = ((x @ cache[dim, tree] > 0).astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=1)
    return out


CELL_KEYS = ["tree", "label", "dim", "cell", "part"]


def _celled(points: DataFrame, trees: list[int]) -> DataFrame:
    """``points`` once for each tree, with its cell and part of it."""
    bounded_batches(points.sparkSession)
    schema = StructType([*points.schema.fields, StructField("tree", LongType()), StructField("code", LongType())])
    at = points.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            lengths = b.column(at).value_lengths().to_numpy(zero_copy_only=False)
            for tree in trees:
                codes = _codes(b.column(at), lengths, tree, cache)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(np.full(len(codes), tree)), pa.array(codes)], [*b.schema.names, "tree", "code"])

    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("__n"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("__n") / F.lit(CELL)))).cast("int")
    celled = points.mapInArrow(run, schema).join(sizes.select("label", "dim", depth.alias("__depth")), ["label", "dim"]).withColumn(
        "cell", F.expr(f"shiftright(code, {BITS} - least(__depth, {BITS}))")).drop("__depth", "code")
    celled = stored(celled, "celled")
    full = stored(celled.groupBy(*CELL_KEYS[:-1]).agg(
        F.ceil(F.count("*") / F.lit(CELL * 2)).alias("__parts")).where("__parts > 1"), "full-cells")
    # one key of all: grouping by columns could keep the join's dealing, which has a full cell in one place
    return celled.join(full, CELL_KEYS[:-1], "left").withColumn(
        "part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", "tree"), F.col("__parts")))).withColumn(
        "key", F.struct(*CELL_KEYS))


# --- balls ------------------------------------------------------------------

def cell_balls(nodes: np.ndarray, x: np.ndarray, weight: np.ndarray, reach: float, least: int) -> list[tuple[int, int]]:
    """(node, pivot) of the nodes that go to another one: the heaviest
    neighbourhood first, ties to the smaller node."""
    near = angles(x @ x.T) <= reach
    np.fill_diagonal(near, True)
    free, out = np.ones(len(nodes), bool), []
    mass = near @ weight
    for i in np.lexsort((nodes, -mass)):
        if mass[i] < least:
            break
        if free[i]:
            mine = near[i] & free
            if weight[mine].sum() >= least and mine.sum() > 1:
                free &= ~mine
                out += [(int(n), int(nodes[i])) for n in nodes[mine] if n != nodes[i]]
    return out


def _balls(nodes: DataFrame, half: float) -> DataFrame:
    """(node, pivot) of all nodes; ``half``: half of the threshold's angle."""
    def run(t: pa.Table) -> pa.Table:
        found = cell_balls(t.column("node").to_numpy(), unit_rows(t.column("vec")), t.column("weight").to_numpy(), half, BALL)
        return pa.table({"node": pa.array([a for a, _ in found], pa.int64()), "pivot": pa.array([b for _, b in found], pa.int64())})

    where = stored(nodes.select("node", F.col("node").alias("pivot")), "pivots")
    for r in range(BALL_ROUNDS):
        weight = where.groupBy("pivot").agg(F.count("*").alias("weight")).withColumnRenamed("pivot", "node")
        live = nodes.select("node", "label", "dim", "vec").join(weight, "node")
        cells = _celled(live, [BALL_TREES + r])
        moved = stored(cells.groupBy("key").applyInArrow(run, "node long, pivot long"), "moved")
        full = not cells.where("__parts > 1").isEmpty()
        if r and moved.isEmpty():
            break
        to = moved.select(F.col("node").alias("pivot"), F.col("pivot").alias("next"))
        going = where.join(to, "pivot")
        # a member follows its pivot only if it is near the new one as well
        vec = nodes.select("node", "vec")
        told = going.join(vec, "node").join(vec.select(F.col("node").alias("next"), F.col("vec").alias("to")), "next").select(
            "node", "next", "vec", "to")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
            for b in batches:
                yield [b.column(0), b.column(1), angles(_row_cosines(b.column(2), b.column(3))) <= half]

        checked = map_batches(told, "node long, next long, near boolean", check).select(
            "node", F.when(F.col("near"), F.col("next")).otherwise(F.col("node")).alias("to"))
        where = stored(where.join(checked, "node", "left").select("node", F.coalesce("to", "pivot").alias("pivot")), "pivots")
        if r and not full:
            break
    return where


def _row_cosines(a, b) -> np.ndarray:
    """Cosines of the vectors of two list columns, row by row."""
    lengths = a.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros(len(lengths))
    for dim in np.unique(lengths):
        at = pa.array(np.flatnonzero(lengths == dim))
        out[at.to_numpy()] = (unit_rows(a.take(at)) * unit_rows(b.take(at))).sum(axis=1)
    return out


def _points(nodes: DataFrame, where: DataFrame) -> DataFrame:
    """(node, label, dim, vec, radius, total, size) of the pivots: the angle
    to their farthest member, and their members' ids and nodes."""
    vec = nodes.select("node", "vec")
    pairs = where.where("node <> pivot").join(vec, "node").join(
        vec.select(F.col("node").alias("pivot"), F.col("vec").alias("to")), "pivot").select("pivot", "vec", "to")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            yield [b.column(0), angles(_row_cosines(b.column(1), b.column(2)))]

    radius = map_batches(pairs, "node long, radius double", measure).groupBy("node").agg(F.max("radius").alias("radius"))
    held = where.join(nodes.select("node", "mult"), "node").groupBy(F.col("pivot").alias("node")).agg(
        F.sum("mult").alias("total"), F.count("*").alias("size"))
    return stored(nodes.select("node", "label", "dim", "vec").join(held, "node").join(radius, "node", "left").select(
        "node", "label", "dim", "vec", F.coalesce("radius", F.lit(0.0)).alias("radius"), "total", "size"), "points")


# --- neighbour lists --------------------------------------------------------

LIST = "u long, v long, sim double, hit boolean"


def hits(sims: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs at the threshold: exactly so between single vectors, by angle
    with both radii where a ball is one of them."""
    reach = ra[:, None] + rb[None, :]
    return (sims >= threshold) | ((reach > 0) & (angles(sims) <= math.acos(threshold) + reach + SLACK))


def _from_cells(points: DataFrame, trees: list[int], threshold: float) -> DataFrame:
    """The best of each node in its cells, and all pairs at the threshold."""
    def run(t: pa.Table) -> pa.Table:
        nodes, radius = t.column("node").to_numpy(), t.column("radius").to_numpy()
        x = unit_rows(t.column("vec"))
        sims = x @ x.T
        hit = hits(sims, radius, radius, threshold)
        np.fill_diagonal(hit, False)
        np.fill_diagonal(sims, -2)
        keep = hit.copy()
        if len(nodes) > NEAR:
            best = np.argpartition(-sims, NEAR - 1, axis=1)[:, :NEAR]
            keep[np.arange(len(nodes))[:, None], best] = True
        else:
            keep[:] = True
        np.fill_diagonal(keep, False)
        i, j = np.nonzero(keep)
        return pa.table({"u": nodes[i], "v": nodes[j], "sim": sims[i, j], "hit": hit[i, j]})

    cells = _celled(points.select("node", "label", "dim", "vec", "radius"), trees)
    return stored(cells.groupBy("key").applyInArrow(run, LIST), "from-cells")


def _ranked(found: DataFrame, places: DataFrame, times: int = 1) -> DataFrame:
    """The nearest of each ``u``: ``times`` its places."""
    by = Window.partitionBy("u").orderBy(F.col("sim").desc(), F.col("v"))
    return found.join(places, "u", "left").withColumn("__at", F.row_number().over(by)).where(
        F.col("__at") <= F.lit(times) * F.coalesce("places", F.lit(NEAR))).drop("__at", "places")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in pairs.columns if c not in "uv"]))


def hub_pairs(ids: np.ndarray, x: np.ndarray, radius: np.ndarray, bar: np.ndarray, new: np.ndarray, threshold: float):
    """Pairs of a hub's neighbours, one of them new to it, that are at the
    threshold or nearer than what the first one's list holds."""
    sims = x @ x.T
    hit = hits(sims, radius, radius, threshold)
    keep = (hit | (sims > bar[:, None])) & (new[:, None] | new[None, :])
    np.fill_diagonal(keep, False)
    i, j = np.nonzero(keep)
    return ids[i], ids[j], sims[i, j], hit[i, j]


def _joined(points: DataFrame, lists: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """Candidates (LIST) among the neighbours, either way, of every node."""
    around = _ranked(_both_ways(lists).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("new").alias("new")), places, 2)
    size = F.coalesce(F.first("places"), F.lit(NEAR))
    bars = lists.join(places, "u", "left").groupBy(F.col("u").alias("v")).agg(
        F.when(F.count("*") >= size, F.min("sim")).otherwise(-2.0).alias("bar"))
    told = around.join(points.select(F.col("node").alias("v"), "radius", "dim", "vec"), "v").join(bars, "v", "left")
    hubs = told.groupBy("u").agg(F.max("new").alias("new"), F.collect_list(
        F.struct("v", "radius", F.coalesce("bar", F.lit(-2.0)).alias("bar"), "new", "vec")).alias("near")).where("new").select("near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            near = b.column(0)
            of = near.flatten()
            ends = np.cumsum(near.value_lengths().to_numpy(zero_copy_only=False))
            ids, radius, bar, new = (of.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            # all neighbours of a hub have one label and one length
            vecs, out, begin = of.field(4), [], 0
            for end in ends:
                if end - begin > 1:
                    here = slice(begin, end)
                    out.append(hub_pairs(ids[here], unit_rows(vecs.slice(begin, end - begin)), radius[here], bar[here],
                                         new[here], threshold))
                begin = end
            if out:
                yield [np.concatenate(c) for c in zip(*out)]

    return map_batches(hubs, LIST, run)


def _edges(found: DataFrame) -> DataFrame:
    return found.where("hit").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim").groupBy("u", "v").agg(
        F.max("sim").alias("sim"))


def _descend(points: DataFrame, found: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """All pairs (u < v, sim) at the threshold that rounds of joins find,
    beginning with lists from ``found``."""
    spark = points.sparkSession
    places = spark.createDataFrame([], "u long, places int")
    lists = None
    known = stored(edges.unionByName(_edges(found)).groupBy("u", "v").agg(F.max("sim").alias("sim")), "edges")
    n = known.count()
    for _ in range(ROUNDS):
        fresh = found.select("u", "v", "sim", F.lit(True).alias("new"), "hit").unionByName(
            _both_ways(known.select("u", "v", "sim", F.lit(True).alias("new"), F.lit(True).alias("hit"))))
        every = fresh if lists is None else lists.withColumn("new", F.lit(False)).unionByName(fresh)
        merged = every.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"), F.max("hit").alias("hit"))
        lists = stored(_ranked(merged, places), "lists")
        # a list that holds nothing but pairs at the threshold gets more places
        full = lists.groupBy("u").agg(F.count("*").alias("held"), F.min("hit").alias("all")).join(places, "u", "left").where(
            F.col("all") & (F.col("held") >= F.coalesce("places", F.lit(NEAR))))
        wider = full.select("u", (2 * F.coalesce("places", F.lit(NEAR))).cast("int").alias("places"))
        grown = not wider.isEmpty()
        places = stored(wider.unionByName(places.join(wider, "u", "left_anti")), "places")
        found = stored(_joined(points, lists, places, threshold), "candidates")
        known = stored(known.unionByName(_edges(found)).groupBy("u", "v").agg(F.max("sim").alias("sim")), "edges")
        before, n = n, known.count()
        if n == before and not grown:
            break
    return known


def audit(points: DataFrame, edges: DataFrame, threshold: float = THRESHOLD, sample: int = AUDIT) -> tuple[float, DataFrame]:
    """The share of the pairs at the threshold of ``sample`` nodes that
    ``edges`` has, and those pairs by comparing them with all nodes."""
    some = points.select("node", F.xxhash64("label").alias("lab"), "dim", "radius", "vec").orderBy(F.xxhash64("node"), "node").limit(sample)
    got = some.toArrow()
    by_dim = {}
    for dim in np.unique(got.column("dim").to_numpy()):
        t = got.filter(pa.compute.equal(got.column("dim"), int(dim)))
        by_dim[int(dim)] = (t.column("node").to_numpy(), t.column("lab").to_numpy(), t.column("radius").to_numpy(), unit_rows(t.column("vec")))
    shared = points.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim, (nodes, labels, radius, x) in shared.value.items():
                at = np.flatnonzero(dims == dim)
                if not len(at):
                    continue
                t = b.take(pa.array(at))
                own, lab, r = (t.column(i).to_numpy() for i in (0, 1, 3))
                sims = x @ unit_rows(t.column(4)).T
                hit = hits(sims, radius, r, threshold) & (labels[:, None] == lab[None, :]) & (nodes[:, None] != own[None, :])
                i, j = np.nonzero(hit)
                yield [nodes[i], own[j], sims[i, j], np.ones(len(i), bool)]

    every = points.select("node", F.xxhash64("label").alias("lab"), "dim", "radius", "vec")
    true = stored(_edges(map_batches(every, LIST, run)), "audit")
    n = true.count()
    return (true.join(edges.select("u", "v"), ["u", "v"]).count() / n if n else 1.0), true


def neighbour_edges(points: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """(u < v, sim): the pairs of points at the threshold, and the share that
    the last audit found."""
    edges = points.sparkSession.createDataFrame([], "u long, v long, sim double")
    recall, tree = 0.0, 0
    for _ in range(TRIES):
        found = _from_cells(points, list(range(tree, tree + TREES)), threshold)
        tree += TREES
        edges = _descend(points, found, edges, threshold)
        recall, true = audit(points, edges, threshold)
        edges = stored(edges.unionByName(true).groupBy("u", "v").agg(F.max("sim").alias("sim")), "edges")
        if recall >= RECALL:
            break
    return edges, recall


# --- links ------------------------------------------------------------------

def _opened(pairs: DataFrame, points: DataFrame, where: DataFrame, nodes: DataFrame, threshold: float):
    """Links between the members of pairs of points of which one at least is
    a ball: (node, n) to add up, and (u, v) that link."""
    theta = math.acos(threshold)
    other = points.select(F.col("node").alias("other"), F.col("vec").alias("to"), "radius", "total")
    sides = pairs.select("u", "v", F.lit(0).alias("side"), F.col("u").alias("pivot"), F.col("v").alias("other")).unionByName(
        pairs.select("u", "v", F.lit(1).alias("side"), F.col("v").alias("pivot"), F.col("u").alias("other")))
    told = sides.join(other, "other").join(where, "pivot").join(nodes.select("node", "mult", "vec"), "node").select(
        "u", "v", "side", "node", "mult", "total", "radius", "vec", "to")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            cos = _row_cosines(b.column(7), b.column(8))
            r, a = b.column(6).to_numpy(), angles(cos)
            every = np.where(r == 0, cos >= threshold, a + r <= theta - SLACK)
            none = np.where(r == 0, cos < threshold, a - r > theta + SLACK)
            yield [*(b.column(i) for i in range(6)), np.where(every, 2, np.where(none, 0, 1))]

    state = map_batches(told, "u long, v long, side int, node long, mult long, total long, state int", settle)
    state = stored(state.where("state > 0"), "sides")
    whole = state.where("state = 2")
    mass = whole.groupBy("u", "v", "side").agg(F.sum("mult").alias("mass")).withColumn("side", 1 - F.col("side"))
    some = state.where("state = 1")
    counted = whole.select("node", F.col("total").alias("n")).unionByName(
        some.join(mass, ["u", "v", "side"]).select("node", F.col("mass").alias("n")))
    # members that neither pivot settles, in blocks of both sides
    parts = some.groupBy("u", "v", "side").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
    dealt = some.join(parts, ["u", "v", "side"]).join(
        parts.select("u", "v", (1 - F.col("side")).alias("side"), F.col("parts").alias("others")), ["u", "v", "side"]).select(
        "u", "v", "side", "node", "mult", F.pmod(F.xxhash64("node"), F.col("parts")).alias("mine"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("theirs"))
    first, second = F.when(F.col("side") == 0, F.col("mine")), F.when(F.col("side") == 0, F.col("theirs"))
    blocks = dealt.select("u", "v", first.otherwise(F.col("theirs")).alias("p"), second.otherwise(F.col("mine")).alias("q"),
                          "side", "node", "mult").join(nodes.select("node", "vec"), "node")

    def compare(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        a, b = (t.filter(pa.array(side == i)) for i in (0, 1))
        if not len(a) or not len(b):
            return pa.table({c: pa.array([], pa.int64()) for c in ("u", "v", "node", "n")})
        link = (unit_rows(a.column("vec")) @ unit_rows(b.column("vec")).T >= threshold).astype(np.int64)
        n = np.concatenate([link @ b.column("mult").to_numpy(), a.column("mult").to_numpy() @ link])
        node = np.concatenate([a.column("node").to_numpy(), b.column("node").to_numpy()])
        at = n > 0
        u, v = a.column("u")[0].as_py(), a.column("v")[0].as_py()
        return pa.table({"u": np.full(at.sum(), u), "v": np.full(at.sum(), v), "node": node[at], "n": n[at]})

    met = stored(blocks.groupBy("u", "v", "p", "q").applyInArrow(compare, "u long, v long, node long, n long"), "met")
    return counted.unionByName(met.select("node", "n")), whole.select("u", "v").unionByName(met.select("u", "v")).distinct()


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    rows = _keyed(vectors)
    nodes = _nodes(rows)
    where = _balls(nodes.select("node", "label", "dim", "vec"), math.acos(threshold) / 2 - SLACK)
    points = _points(nodes, where)
    edges, _ = neighbour_edges(points, threshold)
    size = points.select("node", "size", "total")
    ends = edges.join(size.select(F.col("node").alias("u"), F.col("size").alias("su"), F.col("total").alias("tu")), "u").join(
        size.select(F.col("node").alias("v"), F.col("size").alias("sv"), F.col("total").alias("tv")), "v")
    ends = stored(ends, "edge-sizes")
    single = ends.where("su = 1 and sv = 1")
    counted, met = _opened(ends.where("su > 1 or sv > 1").select("u", "v"), points, where, nodes, threshold)
    across = single.select(F.col("u").alias("node"), F.col("tv").alias("n")).unionByName(
        single.select(F.col("v").alias("node"), F.col("tu").alias("n"))).unionByName(counted)
    comp = components(single.select("u", "v").unionByName(met).select(F.col("u").alias("a"), F.col("v").alias("b")))
    placed = where.join(comp.withColumnRenamed("node", "pivot"), "pivot", "left").select(
        "node", "pivot", F.coalesce("component", "pivot").alias("component"))
    placed = stored(placed.join(nodes.select("node", "low"), "node"), "placed")
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    result = placed.join(lows, "component").join(points.select(F.col("node").alias("pivot"), "total"), "pivot").join(
        across.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").select(
        "node", "component_id", (F.col("total") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    known = stored(nodes.select("node", "label", "f1", "f2").join(result, "node").drop("node"), "linked")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"),
                           F.xxhash64("embedding").alias("f1"), F.xxhash64(F.lit(1), F.col("embedding")).alias("f2"))
    return every.join(known, ["label", "f1", "f2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))


#: The same rows by all pairs of a label and the closure of their links.
SQL = """
WITH RECURSIVE good AS (
  SELECT DISTINCT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.low, e.vec_id)) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(DISTINCT b) AS n_links FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = e.vec_id
"""
