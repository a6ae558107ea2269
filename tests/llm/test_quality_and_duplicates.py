"""Operators 5, 6 and 7, and the pipeline."""
import collections
import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases
import corpus_pipeline
from srcatlas.llm import op05_decontamination as leak, op06_quality_rules as rules, op07_token_groups as near, op09_toxicity as tox, queries

# --- 6: quality rules


def brute_counts(text):
    text = text or ""
    w = cases.WORDS.findall(text)
    lines = [x for x in text.split("\n") if cases.WORDS.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def test_counts_against_brute_force(spark):
    extra = [(20, "a b c d e f g h " * 3), (21, "x " * 30), (22, "one two three\none two three\n \none two three\n"), (23, "p q r s t u v w x p q r s t u v w y"), (24, "<b> #1 $2 %3 & | *")]
    docs = cases.docs_table(spark, cases.DOCS + extra)
    got = rules.report(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    have = sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
    assert have == sorted((str(d), brute_counts(t)) for d, t in cases.DOCS + extra)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert rules.report(cases.empty_docs(spark), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_main_path_is_native(spark):
    plan = rules.with_measures(cases.docs_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def test_op6_query(spark):
    docs = {r.doc_id: r.text for r in cases.given(spark, "documents").collect()}
    rows = queries.op6_quality_rules(spark, cases.SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == {d: brute_counts(t) for d, t in docs.items()}
    assert all(r.kept == (not r.base_failed and r.rule == 0) for r in rows)


def test_rules_separate_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = rules.measured(docs)
    learned = rules.learn(rules.labelled(m, labels.where("doc_id % 2 = 0")))
    assert learned
    got = rules.judge(m, learned).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > .99 and np.mean(bad) < .3


def test_a_conjunction_is_learned_in_order(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1500):
        v = {m: float(rng.random()) for m in rules.RULE_MEASURES}
        bad = (v["symbol_share"] > .7 and v["words"] < .5) or v["mark_share"] > .95
        rows.append((*v.values(), int(bad), i % 3 != 0))
    df = spark.createDataFrame(rows, [*rules.RULE_MEASURES, "bad", "grow"])
    learned = rules.learn(df)
    hit = df.withColumn("rule", rules.rejects(learned, F.col)).collect()
    assert sum(r.rule > 0 for r in hit if r.bad) > .85 * sum(r.bad for r in hit)
    assert sum(r.rule > 0 for r in hit if not r.bad) < .03 * len(hit)
    assert any(len(r.conditions) > 1 for r in learned)
    # the first rule that covers a row names it
    for r in hit[:200]:
        covers = [i for i, rule in enumerate(learned, 1) if all((r[c.measure] > c.threshold) == c.above for c in rule.conditions)]
        assert r.rule == (covers[0] if covers else 0)


@pytest.mark.parametrize("few, bins, narrow", [(1 << 16, 4096, 64), (0, 16, 2), (40, 3, 5)])
def test_cuts_are_exact_quantiles_in_bounded_state(spark, monkeypatch, few, bins, narrow):
    """No aggregate that holds every distinct value."""
    rng = np.random.default_rng(2)
    make = [lambda: float(rng.random()), lambda: float(rng.integers(0, 5)), lambda: float(rng.normal() ** 9), lambda: -1.5, lambda: None]
    rows = [tuple(make[i % 5]() for i in range(len(rules.RULE_MEASURES))) for _ in range(701)]
    df = spark.createDataFrame(rows, ", ".join(f"{m} double" for m in rules.RULE_MEASURES))
    shares = [i / rules.CUTS for i in range(1, rules.CUTS)]
    want = df.agg(*[F.percentile(m, F.array(*map(F.lit, shares))).alias(m) for m in rules.RULE_MEASURES]).first().asDict()
    monkeypatch.setattr(F, "percentile", None)
    for name, value in (("FEW_VALUES", few), ("CUT_BINS", bins), ("NARROW_BINS", narrow)):
        monkeypatch.setattr(rules, name, value, raising=False)
    cuts = rules._cuts(df)
    assert {m: v for m, v in rules._quantiles(df, shares).items()} == {m: v for m, v in want.items() if v}
    assert all(set(want[m] or []) <= set(cuts[m]) for m in rules.RULE_MEASURES)
    assert not any(rules._cuts(df.limit(0)).values())


# --- 7: token groups

def brute_components(docs):
    sets = []
    for d, t in docs:
        w = cases.words(t)
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = docs[i][0] == docs[j][0] is not None
            if docs[i][0] is None or docs[j][0] is None:
                continue
            if same_id or a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def found_components(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near.linked_components(df).collect())


def test_components_of_cases(spark):
    assert found_components(cases.docs_table(spark).repartition(3)) == brute_components(cases.DOCS)
    assert near.linked_components(cases.empty_docs(spark)).count() == 0


def near_copies(n, seed, length=120, vocabulary=3000):
    """Chains of copies with more and more words changed, some far apart."""
    rng = np.random.default_rng(seed)
    out, text = [], None
    for i in range(n):
        if text is None or rng.random() < .25:
            text = [f"w{x}" for x in rng.integers(0, vocabulary, rng.integers(3, length))]
        text = text.copy()
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(0, len(text)))] = f"w{rng.integers(0, vocabulary)}"
        out.append((i * 3 - 7, " ".join(text)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, monkeypatch, seed):
    docs = near_copies(160, seed)
    shared = " ".join(f"s{i}" for i in range(60))
    docs += [(1000 + i, f"{shared} u{i} " + " ".join(f"u{i}x{j}" for j in range(5 + i))) for i in range(40)]
    monkeypatch.setattr(near, "GROUP", 8)
    assert found_components(cases.docs_table(spark, docs).repartition(4)) == brute_components(docs)


def test_op7_query(spark):
    docs = [(r.doc_id, r.text) for r in cases.given(spark, "documents").collect()]
    rows = queries.op7_token_groups(spark, cases.SF).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows) == brute_components(docs)
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in rows) == brute_links(docs)


def brute_links(docs):
    sets = [{tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set() for w in (cases.words(t) for _, t in docs)]
    named = [s if d is not None else set() for (d, _), s in zip(docs, sets)]
    return sorted((str(d), len(s), sum(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(named) if j != i and a and b))
                  for i, ((d, _), s, a) in enumerate(zip(docs, sets, named)))


def found_links(df):
    rows = near.linked_documents(df).collect()
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows), sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in rows)


def test_links_of_cases(spark):
    assert found_links(cases.docs_table(spark).repartition(3)) == (brute_components(cases.DOCS), brute_links(cases.DOCS))
    assert near.linked_documents(cases.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("documents", [4, 40, 512])
def test_links_against_all_pairs(spark, monkeypatch, documents):
    """Whether a component is one block or many, every link is counted."""
    docs = near_copies(150, 3)
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(90)]
    for i in range(120):  # one family of many sizes and distances
        text = base[:int(rng.integers(55, 90))].copy()
        for _ in range(int(rng.integers(0, 3))):
            text[int(rng.integers(0, len(text)))] = f"v{rng.integers(0, 9)}"
        docs.append((2000 + i, " ".join(text)))
    docs += [(3000 + i, " ".join(base)) for i in range(20)]
    monkeypatch.setattr(near, "LINK_ROOM", documents * near.LINK_ROW)
    assert found_links(cases.docs_table(spark, docs).repartition(4)) == (brute_components(docs), brute_links(docs))


def test_union_bound_loses_no_link():
    rng = np.random.default_rng(5)
    core = rng.integers(0, 2 ** 63, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([core[rng.random(80) < .95], rng.integers(0, 2 ** 63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(60)]
    copies = rng.integers(1, 5, 60)
    links = [[i != j and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = np.array(links) @ copies
    assert near.linked_with(sets, copies, sets, copies, same=True)[0].tolist() == want.tolist()
    q, g = slice(0, 25), slice(25, 60)
    to_q, to_g = near.linked_with(sets[q], copies[q], sets[g], copies[g])
    assert to_q.tolist() == (np.array(links)[q, g] @ copies[g]).tolist()
    assert to_g.tolist() == (copies[q] @ np.array(links)[q, g]).tolist()
    assert near.linked_with([], copies[:0], sets, copies)[1].tolist() == [0] * 60


def test_block_products_are_intersections():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(7)]
    cols = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(5)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in cols] for a in rows]
    assert near.overlaps(rows, cols, chunk=8).tolist() == want


def test_bound_never_drops_a_link(spark):
    """For any two sets that link, the query's prefix shares enough."""
    rng = np.random.default_rng(9)
    pairs = [(int(n), int(m)) for n, m in rng.integers(1, 400, (300, 2)) if 100 * min(n, m) >= 85 * max(n, m)]
    need = {(r.a, r.b): r.need for r in spark.createDataFrame(pairs, "a long, b long").distinct().withColumn(
        "need", near._need(F.col("a"), F.col("b"))).collect()}
    for n, m in pairs:
        overlap = -(-85 * (n + m) // 185)
        if overlap <= min(n, m):
            assert need[n, m] <= max(1, near.prefix_length(n) - (n - overlap))


# --- 5: decontamination

ITEMS = [(1, "Which wolves sleep near the frozen lake tonight? Answer: twelve grey wolves under a silver moon"),
         (2, "Otters play among the tall reeds by the slow river. They dive for cold fish until night falls."),
         (3, "red green blue"), (4, None), (5, ""), (None, "A null item speaks of seven copper kettles boiling over in an empty kitchen all night long"),
         (6, "Otters play among the tall reeds by the slow river. They dive for cold fish until night falls.")]
LEAKS = [(1, cases.PROSE), (2, "before " * 300 + ITEMS[0][1].upper() + " after" * 90), (3, ITEMS[1][1].replace("cold ", "very cold ").replace("tall", "high")),
         (4, "Which wolves sleep near the frozen lake tonight? Nobody knows."), (5, None), (6, ""), (7, "red, green; blue."), (8, "red blue green"),
         (9, ITEMS[5][1]), (9, ITEMS[5][1]), (None, ITEMS[1][1]), (10, " ".join([ITEMS[0][1], "filler words go here"] * 400))]


def test_leaks_of_cases(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit(1))
    docs = cases.docs_table(spark, LEAKS)
    got = sorted((str(r.doc_id), str(r.item_id)) for r in leak.contaminated_pairs(docs, items).collect())
    assert got == sorted([("2", "1"), ("3", "2"), ("3", "6"), ("7", "3"), ("9", "None"), ("9", "None"), ("None", "2"), ("None", "6"), ("10", "1")])
    kept = leak.clean_documents(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 8]
    for d, i in ((cases.empty_docs(spark), items), (docs, items.limit(0))):
        assert leak.contaminated_pairs(d, i).count() == 0
        assert leak.clean_documents(d, i).count() == d.count()


@pytest.mark.parametrize("shard_items, block_items", [(20_000, 64), (4, 2)])
def test_retrieval_equals_full_scoring(spark, monkeypatch, shard_items, block_items):
    monkeypatch.setattr(leak, "SHARD_ITEMS", shard_items)
    monkeypatch.setattr(leak, "BLOCK_ITEMS", block_items)
    monkeypatch.setattr(leak, "THRESHOLD", 0.3)
    rng = np.random.default_rng(1)
    word = lambda: f"w{int(rng.zipf(1.4)) % 200}"
    items = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.integers(2, 20)))) for i in range(30)], "item_id long, text string")
    texts = [" ".join(word() for _ in range(rng.integers(0, 150))) for _ in range(25)]
    docs = leak.word_hashes(pa.array(texts, pa.string()))
    n = 0
    for shard in leak.build_index(items):
        got = {(d, w, i): s for d, w, i, s in shard.retrieve(docs)}
        for d, words in enumerate(docs):
            for w in range(-(-len(words) // shard.stride)):
                here = set(words[w * shard.stride:(w + 2) * shard.stride].tolist())
                for i in range(len(shard.words)):
                    score = sum(v for t, v in zip(shard.own_terms[i], shard.own_impacts[i]) if int(shard.terms[t]) in here)
                    if score >= .3 + 1e-6:
                        assert got[d, w, i] == pytest.approx(score)
                        n += 1
                    elif score < .3 - 1e-6:
                        assert (d, w, i) not in got
    assert n > 20


def test_op5_query_finds_every_planted_item(spark):
    docs, items = cases.given(spark, "documents").collect(), cases.given(spark, "benchmark").collect()
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {(d.doc_id, i.item_id) for d in docs for i in items if f" {plain(i.text)} " in f" {plain(d.text)} "}
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, cases.SF).collect()}
    assert want and want <= got


def test_common_subsequence():
    assert leak.in_order([1, 2, 3, 4], [9, 1, 3, 2, 4, 4]) == 3
    assert leak.in_order([], [1]) == 0


def test_scattered_words_are_no_leak(spark):
    """A long item does not loosen the check of a short one."""
    rng = np.random.default_rng(4)
    long_item = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 3000))
    items = spark.createDataFrame([(1, ITEMS[0][1]), (2, long_item)], "item_id long, text string")
    filler = lambda n: " ".join(f"f{i}" for i in rng.integers(0, 10**6, n))
    scattered = " ".join(f"{w} {filler(60)}" for w in ITEMS[0][1].split())
    loose = " ".join(f"{w} {filler(3)}" for w in ITEMS[0][1].split())
    near = ITEMS[0][1].replace("Answer", "some words between them Answer")
    docs = cases.docs_table(spark, [(1, scattered), (2, loose), (3, f"{filler(900)} {near} {filler(50)}"), (4, f"{filler(2000)} {long_item}"),
                                    (5, f"{scattered} {filler(7)} {near} {scattered}")])
    got = sorted((r.doc_id, r.item_id) for r in leak.contaminated_pairs(docs, items).collect())
    assert got == [(3, 1), (4, 2), (5, 1)]
    assert sorted(r.doc_id for r in leak.clean_documents(docs, items).collect()) == [1, 2]


def test_short_last_sentence_is_no_answer(spark):
    """A word or two after the last full stop may differ or be missing; after
    an answer mark the answer must stand there."""
    head = "Otters play among the tall reeds by the slow river and dive for cold fish until night falls on every quiet village"
    items = spark.createDataFrame([(1, f"{head}. Indeed."), (2, f"{head}. So they.")], "item_id long, text string")
    marked = spark.createDataFrame([(3, f"{head}? Answer: twelve wolves"), (4, f"Answer: {head}. Indeed.")], "item_id long, text string")
    docs = cases.docs_table(spark, [(1, f"before {head}. Never. And after"), (2, f"before {head}"), (3, head.replace(" ", " x y ")),
                                    (4, f"{head}? Answer: twelve wolves")])
    pairs = lambda i: sorted((r.doc_id, r.item_id) for r in leak.contaminated_pairs(docs, i).collect())
    assert pairs(items) == [(d, i) for d in (1, 2, 4) for i in (1, 2)]
    assert [p for p in pairs(marked) if p[1] == 3] == [(4, 3)]
    assert [r.doc_id for r in leak.clean_documents(docs, items).collect()] == [3]


def test_best_span_against_every_span():
    rng = np.random.default_rng(5)
    n = 0
    for _ in range(300):
        parts = [rng.integers(0, 6, rng.integers(1, 8)).tolist(), rng.integers(0, 6, rng.integers(1, 5)).tolist()]
        text, at = rng.integers(0, 6, 40).tolist(), np.cumsum(rng.integers(1, 4, 40))
        ends = np.searchsorted(at, at + 12)
        least = [.8 * len(parts[0]), .6 * len(parts[1])]
        every = [tuple(leak.in_order(p, text[i:e]) for p in parts) for i, e in enumerate(ends)]
        ok = [g for g in every if all(x >= y for x, y in zip(g, least))]
        got = leak.best_span(parts, least, text, ends)
        assert (got is None) == (not ok) and (not ok or sum(got) == max(map(sum, ok)))
        n += bool(ok)
    assert 20 < n < 280


# --- pipeline

def test_stages_against_brute_force(spark):
    docs = cases.given(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = stage(spark, now, cases.SF)
        seen.append((name, before, now))
        if name != names[-1]:
            assert now.columns == docs.columns
    left = [{r.doc_id for r in df.collect()} for _, _, df in seen]
    learned = rules.quality_rules(docs, cases.given(spark, "labels"))
    ok = {r.doc_id for r in rules.judge(rules.measured(docs), learned).where("kept").collect()}
    assert left[0] == ok and ok <= {d for d, t in seen[0][1] if not brute_counts(t)[5]}
    assert left[1] <= left[0]
    assert left[2] == {c for _, _, c in brute_components(seen[2][1])}
    hits = leak.contaminated_pairs(spark.createDataFrame(seen[3][1], "doc_id long, text string"), cases.given(spark, "benchmark")).collect()
    assert left[3] == left[2] - {r.doc_id for r in hits}
    assert left[4] == left[3]


def test_pipeline_cases(spark, tmp_path):
    """Nulls, repeated rows and extra columns pass through every stage."""
    for name in ("labels", "benchmark"):
        cases.given(spark, name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = cases.docs_table(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.collect()
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    stay = {d for d, _, c in brute_components(cases.DOCS) if c is None or d == str(c)}
    assert kept == sorted(str(d) for d, _ in cases.DOCS if str(d) in stay) and "None" in kept
    assert corpus_pipeline.packing(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_toxic_documents_go(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, "/root/testdata/sf0.01").collect()}
    scores = {r.doc_id: r.predicted for r in tox.score_documents(docs, tox.fit(docs, labels)).collect()}
    assert kept == {d for d, p in scores.items() if not p}
