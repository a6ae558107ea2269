"""Operators 2, 4, 9 and 10."""
import collections
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases
from srcatlas.llm import ctw, gbt, op02_ctw_scoring as lm, op04_main_text as main_text, op09_toxicity as tox, op10_license_scan as lic, queries

# --- 2: context-tree weighting


def brute_scores(docs):
    """Base and model log10 scores from dictionaries of every node."""
    depth = lm.DEPTH
    train = [(d, t) for d, t in docs if not lm.held_out(d)]
    count, kids = collections.Counter(), collections.defaultdict(set)
    seq = {i: b"\n" * depth + " ".join(cases.words(t)).encode() + b"\n" for i, (d, t) in enumerate(docs)}
    for i, (d, _) in enumerate(docs):
        if lm.held_out(d):
            continue
        s = seq[i]
        for p in range(depth, len(s)):
            for k in range(8):
                pre, bit = (k, s[p] >> (8 - k)), (s[p] >> (7 - k)) & 1
                for n in range(depth + 1):
                    count[pre, s[p - n:p], bit] += 1
                    if n:
                        kids[pre, s[p - n + 1:p]].add(s[p - n:p])
    memo = {}

    def weighted(pre, ctx):
        if (pre, ctx) not in memo:
            a, b = count[pre, ctx, 0], count[pre, ctx, 1]
            e = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(ctx) == depth:
                memo[pre, ctx] = (e, 1.0)
            else:
                split = sum(weighted(pre, c)[0] for c in kids.get((pre, ctx), ()))
                both = math.log(.5) + np.logaddexp(e, split)
                memo[pre, ctx] = (both, math.exp(math.log(.5) + e - both))
        return memo[pre, ctx]

    words = collections.Counter(w for _, t in train for w in cases.words(t))
    total = sum(words.values()) + len(train)
    below = math.log10(total + len(words) + (len(train) > 0) + 1)
    out = []
    for i, (d, t) in enumerate(docs):
        s, score = seq[i], 0.0
        for p in range(depth, len(s)):
            for k in range(8):
                pre, bit, prob = (k, s[p] >> (8 - k)), (s[p] >> (7 - k)) & 1, .5
                for n in range(depth, -1, -1):
                    ctx = s[p - n:p]
                    a, b = count[pre, ctx, 0], count[pre, ctx, 1]
                    w = weighted(pre, ctx)[1]
                    prob = w * ((b if bit else a) + .5) / (a + b + 1) + (1 - w) * prob
                score += math.log10(prob)
        ws = cases.words(t)
        base = sum(math.log10(words[w] + 1) - below for w in ws) + math.log10(len(train) + 1) - below
        known = sum(words[w] > 0 for w in ws) + (len(train) > 0)
        out.append((str(d), lm.held_out(d), len(ws) + 1, known, total, base, score))
    return out


def same_scores(rows, want):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-6)


def test_scores_equal_brute_force(spark, monkeypatch):
    rows = [(r.doc_id, r.text[:400]) for r in cases.given(spark, "documents").limit(14).collect()]
    rows += [(d, t) for d, t in cases.DOCS if d not in (8, 9)]
    same_scores(lm.score_documents(cases.docs_table(spark, rows).repartition(3)).collect(), brute_scores(rows))


def test_scores_of_long_texts_and_nothing(spark):
    rows = lm.score_documents(cases.docs_table(spark)).collect()
    assert len(rows) == len(cases.DOCS) and all(r.score < 0 for r in rows)
    assert lm.score_documents(cases.empty_docs(spark)).count() == 0


def test_without_training_texts(spark):
    d = next(i for i in range(100) if lm.held_out(i))
    r = lm.score_documents(cases.docs_table(spark, [(d, "ab")])).first()
    assert r.train_tokens == 0 and r.n_known == 0
    assert r.score == pytest.approx(3 * 8 * math.log10(.5))


def test_held_out_texts_are_shorter_in_bits_than_bytes(spark):
    rows = [r for r in queries.op2_ctw_scoring(spark, cases.SF).collect() if r.held_out]
    bits = -sum(r.score for r in rows) / math.log10(2) / sum(r.n_bytes for r in rows)
    assert 1.0 < bits < 2.6


def test_log_gamma():
    x = np.array([.5, 1, 1.5, 2, 7.5, 8, 100.5, 1e6])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    seen, n = np.unique(lm.gram_codes(text), return_counts=True)
    ctx = np.unique(seen >> np.uint64(8))[:5]
    every = np.unique(np.concatenate([seen, (ctx[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel()]))
    counts = np.zeros(len(every))
    counts[np.searchsorted(every, seen)] = n
    p = ctw.Subtree(every, counts, 0, lm.DEPTH).estimate().prod(1)
    for c in ctx:
        assert p[every >> np.uint64(8) == c].sum() == pytest.approx(1.0)


# --- 4: main text

MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'


def model_of(spark):
    return main_text.fit_pages(cases.given(spark, "pages"))


@pytest.mark.parametrize("source, text", [
    ("<p>a<p>b", "a b"), ("<div>a<b>b</b>c</div>", "abc"), ("<ul><li>x<li>y</ul>z", "x y z"), ("a<br>b", "a b"),
    ("<p>5 &lt; 6 &amp;amp; &eacute;&#233;</p>", "5 < 6 &amp; éé"), ("x<script>var t='</p>';</script>y", "xy"),
    ("<style>p{}</style>q", "q"), ("<!-- c <p>no</p> -->k", "k"), ("a<!--open", "a"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<p title='a>b'>t</p>", "t"), ("<P CLASS=x>T</P>", "T"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<p>a\n\t  b&nbsp;c</p>", "a b c"), ("</div>w</p>", "w"), ("<textarea>no</textarea>yes", "yes"), ("<p x=\"open>t", "t"), ("", ""), ("<", "<"),
])
def test_parsing(source, text):
    page = main_text.parse(source)
    assert main_text.text_of(page, [not u for u in page.unseen]) == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<li>", "<td>", "<a href=x>", "</a>", "text ", "<br>", "<!--", "-->", "<script>", "</script>", "<", ">", "&amp;", "<table>", "</table>", '"']), max_size=30))
def test_any_markup_is_read(parts):
    page = main_text.parse("".join(parts))
    x, own = main_text.features(page)
    assert x.shape == (len(page.parent), main_text.N_FEATURES) and np.isfinite(x).all()
    kept = main_text.decode(page, np.zeros(len(x)), own, main_text.subtree_chars(page, own))
    assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(5)
    for trial in range(30):
        page = main_text.Page()
        for i in range(1, 8):
            q = int(rng.integers(0, i))
            for field, v in (("parent", q), ("tag", rng.choice(["div", "p"])), ("groups", 0), ("above", 0), ("depth", page.depth[q] + 1), ("unseen", False), ("tags", 0), ("controls", 0)):
                getattr(page, field).append(v)
        own, lo = rng.integers(1, 50, 8).astype(float), rng.normal(0, 3, 8)
        kept = main_text.decode(page, lo, own, main_text.subtree_chars(page, own))
        weight = np.sqrt(1 + own) + .5

        def value(k):
            if not k[0] or any(k[i] and not k[page.parent[i]] for i in range(1, 8)):
                return -1e9
            v = sum((-np.logaddexp(0, -lo[i]) if k[i] else -np.logaddexp(0, lo[i])) * weight[i] for i in range(1, 8))
            for q in range(8):
                line = [i for i in range(1, 8) if page.parent[i] == q]
                if k[q]:
                    v -= sum(main_text.PARTING for a, b in zip(line, line[1:]) if page.tag[a] == page.tag[b] == "p" and k[a] != k[b])
            return v
        best = max(value([True] + [bool(m >> i & 1) for i in range(7)]) for m in range(128))
        assert value(kept) == pytest.approx(best)


def test_boosted_trees_learn_a_conjunction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > .5) & (x[:, 3] < .3)).astype(float)
    m = gbt.fit(x, y, np.ones(2000), trees=40)
    t = rng.random((500, 5))
    assert ((m.log_odds(t) > 0) == ((t[:, 0] > .5) & (t[:, 3] < .3))).mean() > .97


def test_pages_and_other_layouts(spark):
    model = model_of(spark)
    rows = cases.given(spark, "pages").collect()
    right = 0
    for r, got in zip(rows, main_text.extract_all([r.html for r in rows], model)):
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        import html as h
        right += got == " ".join(h.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
    assert right >= .97 * len(rows)
    one, two = cases.PROSE.capitalize() + ".", "Otters swim, dive and sleep; " * 6 + "they do."
    head = f'<html><head><title>T</title></head><body>{MENU}<header><p>Some site of ours</p></header>'
    tail = ('<aside class="sidebar"><h3>More</h3><ul><li><a href="#">Another story</a></li></ul></aside>'
            '<div id="comments"><h3>Comments</h3><div class="comment"><p>I like this long story, it is good to read it again.</p></div></div>'
            '<form><label>Mail</label><input><button>Go</button></form><footer><p>Copyright us. All rights reserved.</p></footer></body></html>')
    for body in (f"<article><h1>Wolves</h1><p>{one}</p><p>{two}</p></article>", f'<div class="post-content"><h1>Wolves</h1><p>{one}</p><p>{two}</p></div>',
                 f'<main><h1>Wolves</h1><p>{one}</p><div class="advert"><p>Buy now, it is cheap.</p></div><p>{two}</p></main>'):
        assert main_text.extract(head + body + tail, model) == f"Wolves {one} {' '.join(two.split())}"


def test_op4_cases(spark):
    page = f"<html><body>{MENU}<article><p>{cases.PROSE}</p></article></body></html>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (None, "u", page), (4, "u", MENU), (5, "u", "<article><p>" + (cases.PROSE + " ") * 3000)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    model = model_of(spark)
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in main_text.main_texts(df, model).collect())
    assert [g[0] for g in got] == ["1", "2", "3", "3", "4", "5", "None"]
    by = {g[0]: g for g in got}
    assert by["1"][1:] == by["2"][1:] == ("", 0) and by["3"][1] == cases.PROSE == by["None"][1]
    assert by["5"][2] == 3000 * (len(cases.PROSE) + 1) - 1
    empty = df.limit(0)
    assert main_text.main_texts(empty, main_text.fit_pages(empty)).count() == 0
    assert main_text.extract(page, None) == cases.PROSE


# --- 9: toxicity

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


LEXICON = {"idiot": 1, "worthless": 2, "scum": 0, "trash": 1, "thrash": 1}


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet="idotscumrahwle", max_size=11), st.sampled_from(list(LEXICON)).flatmap(
    lambda w: st.tuples(st.just(w), st.lists(st.tuples(st.integers(0, 10), st.sampled_from(["", "x", "o", "ss"])), max_size=3)))))
def test_automaton_against_distances(word):
    if isinstance(word, tuple):
        w, changes = word
        for at, by in changes:
            w = w[:at] + by + w[at + 1:]
        word = w
    lexicon = tox.FuzzyLexicon(LEXICON, ["vequ"])
    near = [(distance(word, t), t) for t, k in LEXICON.items() if distance(word, t) <= k]
    got = lexicon.find(word)
    if near:
        assert got is not None and got[1] == min(near)[0]
        assert (got[1], got[0]) == min(near)
    else:
        assert got == (("*", 3) if word.startswith("vequ") else None)


def test_context_parts_quotation_from_abuse():
    m = tox.ToxicityModel({"idiot": 1, "loser": 1}, [], tox.PRIOR * 3, -3.0)
    abuse = "you are an idiot and an idoit and a loser"
    quote = 'he said the word "idiot" was wrong, and the term "loser" too'
    assert [(h[1], h[2]) for h in m.hits(abuse)] == [("idiot", 0), ("loser", 0)]
    assert [h[4] > 0 for h in m.hits(quote)] == [True, True] and not any(h[4] > 0 for h in m.hits(abuse))
    assert m.score(abuse) > .5 > m.score(quote)
    assert [(h[0], h[2]) for h in m.hits("such idiiot, such idot")] == [("idiiot", 1), ("idot", 1)]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in tox.score_documents(docs, tox.fit(docs, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= .5) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    auc = np.mean([(b > g) + .5 * (b == g) for b in bad for g in good])
    assert auc > .9 and np.mean([s >= .5 for s in good]) < .02


def test_toxicity_cases(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    docs = cases.docs_table(spark)
    rows = tox.score_documents(docs, tox.fit(docs, labels)).collect()
    assert len(rows) == len(cases.DOCS) and all(0 <= r.score <= 1 for r in rows)
    none = tox.fit(docs, labels.limit(0))
    assert all(r.score < 1e-6 for r in tox.score_documents(docs, none).collect())
    assert tox.score_documents(cases.empty_docs(spark), none).count() == 0
    assert tox.fit(cases.empty_docs(spark), labels).words == {}


# --- 10: licences

def brute_phrases(text):
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(cases.LOWER))
    at, labels = [], set()
    for phrase, label in lic.BASE_PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "mit", "License", "license.", "apache", "general", "public", "x1", "é", "--", "\n", "mit-license", "É"]), max_size=25), st.sampled_from([" ", "  ", "\x00"]))
def test_phrases_against_brute_force(parts, glue):
    text = glue.join(parts)
    assert lic.scan_text(text)[:5] == brute_phrases(text)


def edited(text, k, rng):
    for _ in range(k):
        i, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:i] + ("" if kind == 0 else rng.choice("abcxyz")) + text[i + (kind != 2):]
    return text


def test_notices_are_found_within_their_edits():
    rng = random.Random(4)
    for notice, label in lic.NOTICES:
        k = len(notice) // lic.CHARS_PER_EDIT
        for edits in range(k + 1):
            changed = edited(notice, edits, rng)
            found = lic.find_notices(f" some words before {changed} and some after ")
            assert any(f[0] == label and f[3] <= edits for f in found), (notice, changed)


def test_far_texts_are_not_notices():
    assert lic.find_notices(lic.normal_form(cases.PROSE)) == []
    assert lic.scan_text("the licence of a poet")[5:7] == ("", 0.0)
    _, _, _, _, base, labels, score, spans = lic.scan_text("Relesed under the MIT Licence!")
    assert (base, labels) == ("", "mit") and 0 < score < 1 and spans[0][3] >= 2


def test_worse_matches_beside_the_best_are_found():
    text = "abcdefghijklmnopqrstuvwxyz"
    find = lambda norm: lic.find_notices(norm, notices=((text, "x"),), chars_per_edit=13)
    one, two = text.replace("m", "?"), text.replace("d", "?").replace("t", "?")
    assert find(f" {one} {text} ") == [("x", 1, 27, 1), ("x", 28, 54, 0)]
    many = [one, two, text, two, one, text, one, one, two] * 6
    got = find(f" {' '.join(many)} ")
    assert [(s, e, n) for _, s, e, n in got] == [(1 + 27 * i, 27 + 27 * i, t.count("?")) for i, t in enumerate(many)]


def test_op10_query_and_cases(spark):
    for df, rows in ((cases.given(spark, "documents"), [(r.doc_id, r.text) for r in cases.given(spark, "documents").collect()]),
                     (cases.docs_table(spark), cases.DOCS)):
        got = sorted((str(r.doc_id), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in lic.scan_licenses(df).collect())
        assert got == sorted(((str(d), brute_phrases(t)) for d, t in rows))
    assert lic.scan_licenses(cases.empty_docs(spark)).count() == 0


def test_many_near_notices_take_time_in_proportion():
    import time
    rng = random.Random(7)
    notices = [n for n, _ in lic.NOTICES if len(n) >= 28]

    def seconds(n):
        norm = " " + " ".join(edited(rng.choice(notices), 2, rng) for _ in range(n)) + " "
        t = time.perf_counter()
        found = lic.find_notices(norm)
        return time.perf_counter() - t, len(found)

    seconds(50)
    (short, few), (long, many) = seconds(500), seconds(2000)
    assert few >= 450 and many >= 1800 and long < 8 * short


def test_spans_of_one_notice_do_not_overlap():
    rng = random.Random(8)
    notice = "licensed under the apache license version 2 0"
    norm = " " + "".join(edited(notice, rng.randrange(4), rng)[rng.randrange(12):] for _ in range(60)) + " "
    spans = sorted((s, e) for _, s, e, _ in lic.find_notices(norm, notices=((notice, "x"),)))
    assert len(spans) > 10 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_apostrophes_are_no_quotation_marks():
    m = tox.ToxicityModel({"idiot": 1, "loser": 1}, [], tox.PRIOR * 3, -3.0)
    plain = "Don't you see it, idiot, it's plain that the loser can't"
    curly = plain.replace("'", "’")
    assert m.score(curly) == m.score(plain) > .5
    for a, b in ("“”", "„“", "«»", "‘’", '""'):
        quote = f"the word {a}idiot{b} is one that they don’t say"
        assert m.hits(quote)[0][4] > 0, quote
    # a mark that opens must stand before, and its own closing one after
    assert not any(h[4] > 0 for h in m.hits("such an idiot” and ‘ that"))


def test_nested_stems_and_a_large_lexicon():
    marked = {"vek": 10, "vekt": 10, "vekto": 9, "zorb": 8, "zor": 30, "zorbi": 8, "ama": 5, "am": 5}

    def slow(marked):
        best = [s for s in marked if not any(t != s and t.startswith(s) and marked[t] >= .98 * marked[s] for t in marked)]
        kept = []
        for s in sorted(best, key=lambda s: (len(s), s)):
            if not any(s.startswith(k) for k in kept):
                kept.append(s)
        return kept

    assert tox.outer_stems(marked) == slow(marked) == ["ama", "zor", "vekt"]
    rng = random.Random(1)
    many = {"".join(rng.choices("abcd", k=rng.randrange(3, 8))): rng.randrange(1, 40) for _ in range(400)}
    assert tox.outer_stems(many) == slow(many)
    words = sorted({"".join(rng.choices("bcdfghklmnprst", k=8)) for _ in range(5000)})
    lexicon = tox.FuzzyLexicon({w: 0 for w in words}, [])
    assert all(lexicon.find(w) == (w, 0) for w in words[::37]) and lexicon.find("aaaaaaaa") is None


def test_no_term_of_the_lexicon_is_left_out_for_its_number(spark, monkeypatch):
    rng = random.Random(3)
    bad = sorted({"".join(rng.choices("bcdfghklmnprstvz", k=7)) for _ in range(2600)})
    rows = [(" ".join(bad), 1)] * 6 + [(cases.PROSE, 0)] * 6
    words, stems = tox.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    held = set(words) | set(stems)
    assert all(w in held or any(w.startswith(s) for s in stems) for w in bad) and len(held) > 2000


def test_the_sample_of_pages_does_not_depend_on_partitions(spark):
    pages = cases.given(spark, "pages")
    twice = pages.unionByName(pages.limit(20))  # repeated rows
    seen = []


    def train(html):
        seen.append(html)

    before = main_text.train
    main_text.train = train
    try:
        for df in (pages.repartition(1), pages.repartition(48), twice.repartition(7), pages.limit(0)):
            main_text.fit_pages(df)
    finally:
        main_text.train = before
    assert seen[0] == seen[1] == seen[2] and 0 < len(seen[0]) <= main_text.FIT_PAGES and seen[3] == []
