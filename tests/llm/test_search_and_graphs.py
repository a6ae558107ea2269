"""Operators 11, 12 and 13."""
import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases
from srcatlas.llm import op11_dual_tree as search, op12_nn_descent as graph, op13_radix_trie as trie, queries

# --- 11: dual-tree search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k=10):
    terms = [(d, Counter(TERMS.findall((t or "").translate(cases.LOWER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERMS.findall((t or "").translate(cases.LOWER)))
    out = []
    for i, q in asked.items():
        found = []
        for d, c in terms:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in q if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dual_tree_equals_brute_force_on_given_tables(spark):
    docs, items = cases.given(spark, "documents"), cases.given(spark, "benchmark")
    want = brute_ranks([tuple(r) for r in docs.select("doc_id", "text").collect()],
                       [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows(queries.QUERIES["op11_dual_tree"](spark, cases.SF)) == want


def test_dual_tree_cases_in_several_shards(spark):
    items = [(1, cases.PROSE), (1, "текст wolves"), (2, None), (3, ""), (None, "ÜNÏCÖDÉ grey x1"), (4, "zzz"), (5, "lazy LAZY-dog 日本語")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = search.ranked(cases.docs_table(spark), table, shard_terms=12)
    assert rows(got) == brute_ranks(cases.DOCS, items)
    assert search.ranked(cases.empty_docs(spark), table).count() == 0
    assert search.ranked(cases.docs_table(spark), table.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 400), st.integers(1, 60))
def test_dual_tree_of_a_block_keeps_the_best(seed, n_docs, n_items):
    rnd = np.random.default_rng(seed)
    n_terms = 50
    keys = np.unique(rnd.integers(0, n_docs * n_terms, n_docs * 6))
    row, term = keys // n_terms, keys % n_terms
    # few distinct values: many equal scores
    coords = rnd.integers(1, 4, len(keys)) * 10 ** int(rnd.integers(0, 9))
    sets = [np.unique(rnd.integers(0, n_terms, rnd.integers(1, 8))) for _ in range(n_items)]
    ids = rnd.permutation(n_docs).tolist()
    tree = search.ItemTree(sets, rnd.integers(1, 9, n_terms))
    best = search.Best(np.ones(n_items, np.int64), 5)
    search.search_block(tree, search.DocTree(row, term, coords, n_docs, n_terms), ids, best, np.zeros(n_terms, np.int64), np.float64)
    dense = np.zeros((n_docs, n_terms), np.int64)
    dense[row, term] = coords
    for i, s in enumerate(sets):
        score = dense[:, s].sum(axis=1)
        want = sorted((-int(score[d]), ids[d]) for d in range(n_docs) if score[d])[:5]
        assert sorted((-s, d) for j, d, s in best.rows() if j == i) == want


def test_dual_tree_opens_few_documents_of_unlike_groups():
    # 64 groups with words of their own: an item of one group opens that group
    n_docs, n_terms = 64 * 64, 64 * 4
    row = np.repeat(np.arange(n_docs), 4)
    term = (row // 64) * 4 + np.tile(np.arange(4), n_docs)
    coords = 1 + (row * 7 + term) % 50
    tree = search.ItemTree([np.array([8, 9])], np.ones(n_terms, np.int64))
    best = search.Best(np.ones(1, np.int64), 10)
    opened = search.search_block(tree, search.DocTree(row, term, coords, n_docs, n_terms), list(range(n_docs)), best,
                                 np.zeros(n_terms, np.int64), np.float64)
    assert len(best.heaps[0]) == 10 and opened <= 128


# --- 12: NN-descent


def brute_links(table, threshold=0.93):
    """{row: (n_links, component)} of distinct (vec_id, label, vector)."""
    good = sorted({(i, l, tuple(v)) for i, l, v in table if i is not None and l is not None and v
                   and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    n = [set() for _ in good]
    low = [g[0] for g in good]
    unit = [np.array(g[2], np.float32).astype(float) for g in good]
    unit = [v / np.linalg.norm(v) for v in unit]
    for a in range(len(good)):
        for b in range(len(good)):
            if a != b and good[a][1] == good[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a].add(b)
    changed = True
    while changed:
        changed = False
        for a in range(len(good)):
            least = min([low[a], *(low[b] for b in n[a])])
            changed |= least != low[a]
            low[a] = least
    return {g: (len(n[a]), low[a]) for a, g in enumerate(good)}


def group(rnd, centre, n, noise):
    return [(centre + rnd.normal(0, noise, len(centre))).astype(np.float32).tolist() for _ in range(n)]


def test_nn_descent_equals_brute_force_on_groups_of_all_sizes(spark):
    rnd = np.random.default_rng(5)
    dim, table, ids = 24, [], iter(range(10, 10 ** 6))
    for label, (size, noise) in enumerate([(300, .02), (90, .05), (40, .08), (12, .05), (2, .06)]):
        centre = rnd.normal(0, 1, dim)
        table += [(next(ids), label % 2, v) for v in group(rnd, centre, size, noise * np.linalg.norm(centre) / 2)]
    table += [(next(ids), int(rnd.integers(0, 2)), v) for v in group(rnd, np.zeros(dim), 500, 1)]
    rnd.shuffle(table)
    table = [(int(i), int(l), v) for i, l, v in table]
    df = spark.createDataFrame(table, "vec_id long, label int, embedding array<float>")
    want = {g[0]: v for g, v in brute_links(table).items()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.linked(df).collect()}
    right = sum(got[i] == want[i] for i in want if want[i][0])
    assert len(got) == len(table)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert right >= 0.95 * sum(w[0] > 0 for w in want.values()) and sum(w[0] > 300 for w in want.values()) >= 0


def test_nn_descent_cases(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, 1, [1., 0.]), (2, 1, [1., .01]), (2, 1, [1., .01]), (3, 1, [2., 0.]), (4, 2, [1., 0.]), (5, None, [1., 0.]),
             (6, 1, None), (7, 1, []), (8, 1, [0., 0.]), (9, 1, [nan, 1.]), (10, 1, [inf, 0.]), (11, 1, [None, 1.]),
             (None, 1, [1., 0.]), (12, 1, [1., 0., 0.]), (0, 1, [0., 1.]), (13, 1, [-1., 0.]), (1, 1, [.001, 1.])]
    df = spark.createDataFrame([(*r, 5, 6) for r in table], "vec_id long, label int, embedding array<float>, node long, pivot long")
    got = Counter(tuple(r) for r in graph.linked(df).collect())
    want = Counter()
    links = brute_links(table)
    for i, l, v in table:
        n, low = links.get((i, l, tuple(v or ())), (0, i))
        want[i, n, low, i == low] += 1
    assert got == want
    empty = graph.linked(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_nn_descent_copies_and_pairs_of_balls(spark):
    # two dense groups, each a ball, at an angle where only some pairs link
    rnd = np.random.default_rng(2)
    a = np.r_[1., np.zeros(15)]
    theta = math.acos(0.93)
    b = np.r_[math.cos(theta), math.sin(theta), np.zeros(14)]
    table = [(i, 1, v) for i, v in enumerate(group(rnd, a, 80, .02) + group(rnd, b, 80, .02) + [a.tolist()] * 100)]
    df = spark.createDataFrame(table, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph.linked(df).collect()}
    want = {g[0]: v for g, v in brute_links(table).items()}
    assert got == want and len({n for n, _ in want.values()}) > 20


def test_the_audit_counts_what_is_missing(spark):
    rnd = np.random.default_rng(3)
    centre = rnd.normal(0, 1, 16)
    points = spark.createDataFrame([(i, 1, 16, v, 0.0) for i, v in enumerate(group(rnd, centre, 20, .02))],
                                   "node long, label int, dim int, vec array<float>, radius double")
    half = spark.createDataFrame([(u, v) for u in range(20) for v in range(u + 1, 20) if (u + v) % 2], "u long, v long")
    recall, true = graph.audit(points, half)
    assert recall == pytest.approx(100 / 190) and true.count() == 190


def test_nn_descent_on_the_given_vectors(spark):
    got = queries.QUERIES["op12_nn_descent"](spark, cases.SF).collect()
    table = [(r.vec_id, r.label, r.embedding) for r in cases.given(spark, "embeddings").collect()]
    want = {g[0]: v for g, v in brute_links(table).items()}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


# --- 13: radix trie


def brute_trie(table):
    by = defaultdict(list)
    for c, t, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            tid = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + len(text).to_bytes(4, "big")
            by[c].append(((t is not None, t or 0, tid), (role, text)))
    own = {c: [v for _, v in sorted(x, key=lambda z: z[0])] for c, x in by.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(k[-1][1]) if k else 0) * (len(members[k]) - 1) + sum(saved[x] for x in kids[k])
    return sorted([(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k)))).encode()).hexdigest())
                   for k, m in members.items()], key=str)


def random_conversations(seed, n):
    rnd = random.Random(seed)
    return [(rnd.randrange(-250, 350) if rnd.random() < .97 else None, rnd.choice([None, *range(9)]), rnd.choice(["u", "a", None]),
             rnd.choice([None, "", "x", "yy", "é日"])) for _ in range(n)]


def test_trie_equals_brute_force_on_given_tables(spark):
    table = [tuple(r) for r in cases.given(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows(queries.QUERIES["op13_radix_trie"](spark, cases.SF)) == brute_trie(table)


def test_trie_cases(spark):
    table = random_conversations(1, 1500) + [(c, t, "u", str(t)) for c in range(1000, 1150) for t in range(12)]
    table += [(5000, t, "u", "long") for t in range(700)] + [(5100, t, "u", "long") for t in range(640)]
    df = spark.createDataFrame([(*r, 1, "x") for r in table],
                               "conv_id long, turn long, role string, text string, key int, part string")
    assert rows(trie.trie_nodes(df)) == brute_trie(table)
    assert trie.trie_nodes(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(1, 12), st.integers(1, 120))
def test_trie_blocks_add_up_wherever_they_are_cut(seed, cut, n):
    rnd = random.Random(seed)
    turn = [hashlib.sha256(bytes([i])).digest()[:16] + (i + 1).to_bytes(4, "big") for i in range(4)]
    strings = sorted({b"".join(rnd.choices(turn, k=rnd.randrange(7))) for _ in range(n)})
    values = [(rnd.randrange(1, 4), rnd.randrange(1000), f"h{i}") for i in range(len(strings))]
    parts = []
    for lo in range(0, len(strings), cut):
        hi = lo + cut
        parts += trie.block_nodes(strings[lo:hi], values[lo:hi], strings[lo - 1] if lo else None, strings[hi] if hi < len(strings) else None)
    whole = list(trie.block_nodes(strings, values, None, None))
    assert all(r[0] is None for r in whole)
    edges = defaultdict(list)
    for r in parts:
        if r[0] is not None:
            edges[r[0]].append(r)
    added = {k: (x[0][2], min(r[3] for r in x), *[sum(r[i] for r in x) for i in (5, 6, 7, 8)], max((r[9] or "") for r in x), x[0][1])
             for k, x in edges.items()}
    low = {k: v[1] for k, v in added.items()}
    got = [(v[0], v[1], low.get(v[7]), *v[2:7]) for v in added.values()]
    got += [(r[2], r[3], low[r[1]] if r[1] is not None else r[4], *r[5:9], r[9] or "") for r in parts if r[0] is None]
    assert sorted(got, key=str) == sorted([(r[2], r[3], r[4], *r[5:9], r[9] or "") for r in whole], key=str)


def test_tree_layouts_grow_and_stay_in_order():
    rnd = random.Random(3)
    tree, held = trie.RadixTree(), {}
    for _ in range(3000):
        key = bytes(rnd.choices(range(256), k=rnd.randrange(1, 4)))
        held[key] = len(held)
        tree.insert(key, held[key])
    kinds = Counter(type(n.kids).__name__ + str(getattr(n.kids, "room", "")) for n in tree.post_order() if n.kids is not None)
    assert {"Few4", "Few16", "Direct"} <= set(kinds)
    few = trie.Few()
    for b in range(256):
        few = few.put(b ^ 0x55, b)
        assert few.get(b ^ 0x55) == b
    assert [few.get(b) for b in range(256)] == few.in_order() == [b ^ 0x55 for b in range(256)]
    assert {n.key[:n.depth]: n.value for n in tree.post_order() if n.value is not None} == held


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 40)
    table = [(c, 0, "u", "same") for c in range(100, 400)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert rows(trie.trie_nodes(df)) == brute_trie(table)


@pytest.mark.parametrize("name", ["op11_dual_tree", "op12_nn_descent", "op13_radix_trie"])
def test_sql_states_the_same_rows(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{cases.SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, cases.SF)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows(got.select(*names)) == sorted(want.fetchall(), key=str) and sorted(names) == sorted(got.columns)


def test_hub_pairs_look_only_at_new_neighbours():
    x = graph.unit_rows(pa.array([[1., 0.], [1., .1], [0., 1.]]))
    bar, radius = np.array([-2., -2., .5]), np.zeros(3)
    u, v, _, hit = graph.hub_pairs(np.arange(3), x, radius, bar, np.array([True, False, False]), .93)
    assert sorted(zip(u.tolist(), v.tolist(), hit.tolist())) == [(0, 1, True), (0, 2, False), (1, 0, True)]
