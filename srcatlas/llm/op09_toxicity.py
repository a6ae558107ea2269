"""Toxicity: a lexicon trie intersected with Levenshtein automata, and
context windows that tell quotation from abuse.

The lexicon is learned: words, and stems shared by several words, that the
labelled training rows hold in toxic texts almost only. The trie and the
automaton of "within k edits" are intersected by the subset construction,
state by state as words ask for them, into one deterministic automaton; most
words leave it after three or four characters, and each distinct word of a
task is walked once. Each hit gets a context score from the words and marks
around it (quotation marks, words of reporting, direct address). A logistic
model over the counts of plain and quoted hits gives the score.

Training reads a sample of about ``FIT_ROWS`` labelled rows at most (the lowest
by a hash of doc_id), never held-out ones; the driver gets only the lexicon,
whose terms must each stand in a share of the sample's toxic texts, and this
sample's few numbers a row. Scoring is per row, without a shuffle.

Defined results: a null or empty text has no hits and gets the score of a text
without hits; without labels of both kinds the score is the share of toxic
labels (0 without any); labels with nulls teach nothing and a repeated label
row counts once; repeated rows are scored each; a null ``doc_id`` is not held
out; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, map_batches, stored, text_bytes, word_bounds

#: Labelled rows that the lexicon and the model are fitted on, at most. Of
#: more, those below a bound on a hash of doc_id are taken, so about this many:
#: the bound aims at FIT_SHARE of them.
FIT_ROWS, FIT_SHARE = 20_000, 0.96
#: A term must stand in this many toxic training texts, and in this share of
#: them; and toxic ones must be this share of the texts that hold it.
MIN_TEXTS, MIN_SPREAD, MIN_SHARE = 5, 0.01, 0.9
#: Lengths of stems; a stem joins this many different words, none of which
#: makes up more than this share of it.
STEM_LENGTHS, STEM_WORDS, STEM_TOP = range(3, 8), 4, 0.6
#: Words on either side of a hit that make its context.
CONTEXT_WORDS = 5

WORD = re.compile(r"[^\W_]+")
#: Marks and words that go with a quotation or with address.
QUOTES = {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‘": "’"}
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes word term insult reported "
                      "dit appelle mot sagte nannte wort dijo palabra".split())
_APOSTROPHE = re.compile(r"(?<=[^\W_])[‘’](?=[^\W_])")
ADDRESS = frozenset("you your youre u du ihr dein tu toi vous tus eres".split())


def edits_for(term: str) -> int:
    """Most edits for a lexicon word of this length."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """The deterministic automaton of all words within the allowed edits of a
    lexicon word, or beginning with a stem. States are made when first met."""

    STATES = 100_000

    def __init__(self, words: dict[str, int], stems: list[str]):
        """words: lexicon words with the edits that each one allows."""
        self._kids: list[dict[str, int]] = [{}]
        self._word: list[str | None] = [None]
        self._stem: list[bool] = [False]
        self._most = [0]                                # edits allowed below a node
        self._edits = words
        for t, k in words.items():
            self._add(t, False, k)
        for t in stems:
            self._add(t, True, 0)
        self._start_over()

    def _add(self, term: str, stem: bool, k: int) -> None:
        at = 0
        self._most[0] = max(self._most[0], k)
        for c in term:
            if c not in self._kids[at]:
                self._kids[at][c] = len(self._kids)
                self._kids.append({})
                self._word.append(None)
                self._stem.append(False)
                self._most.append(0)
            at = self._kids[at][c]
            self._most[at] = max(self._most[at], k)
        if stem:
            self._stem[at] = True
        else:
            self._word[at] = term

    def _start_over(self) -> None:
        self._next: list[dict[str, int]] = []
        self._hit: list[tuple[str, int] | None] = []
        self._sets: list[frozenset] = []
        self._number: dict[frozenset, int] = {}
        self._dead = self._state(frozenset())
        self._start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With characters of the lexicon word left out of the text's word,
        and only the fewest edits for each node."""
        todo, best = list(pairs), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e or e > self._most[node] and not (e == 0 and self._stem[node]):
                continue
            best[node] = e
            if e < self._most[node]:
                todo += [(kid, e + 1) for kid in self._kids[node].values()]
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self._number:
            self._number[pairs] = len(self._sets)
            self._sets.append(pairs)
            self._next.append({})
            hits = [(e, self._word[n]) for n, e in pairs if self._word[n] is not None and e <= self._edits[self._word[n]]]
            # 3: by a stem; else the number of edits
            stems = [(3, "*") for n, e in pairs if self._stem[n] and e == 0]
            self._hit.append(min(hits + stems)[::-1] if hits or stems else None)
        return self._number[pairs]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self._sets[state]:
            if self._stem[node] and e == 0:
                out.add((node, 0))
            kid = self._kids[node].get(c)
            if kid is not None:
                out.add((kid, e))
            if e < self._most[node]:
                out.add((node, e + 1))
                out.update((k, e + 1) for k in self._kids[node].values())
        to = self._next[state][c] = self._state(self._closed(out))
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """(lexicon word, edits), or ("*", 3) for a stem, or None."""
        if len(self._sets) > self.STATES:
            self._start_over()
        at, dead, nexts = self._start, self._dead, self._next
        for c in word:
            to = nexts[at].get(c)
            at = self._step(at, c) if to is None else to
            if at == dead:
                return None
        return self._hit[at]


class _Known(dict):
    """Word -> hit or None, for one task's words."""

    def __init__(self, lexicon: FuzzyLexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        hit = self[word] = self.lexicon.find(word)
        return hit


#: What a hit of 0, 1 or 2 edits counts.
HIT_WORTH = (1.0, 0.9, 0.8)
#: Where the weights are drawn to while the labels say nothing else: plain
#: hits, quoted hits, hits by a stem, any plain hit, plain hits a 100 words.
PRIOR = np.array([2.0, -0.5, 1.0, 1.0, 0.2])


@dataclass
class ToxicityModel:
    words: dict[str, int]
    stems: list[str]
    weights: np.ndarray
    bias: float
    _known: _Known | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_known": None}

    def hits(self, text: str) -> list[tuple[str, str, int, int, float]]:
        """(word, lexicon word, edits or 3 for a stem, place, context score)
        of each hit; the context score is above 0 for a quotation."""
        if self._known is None:
            self._known = _Known(FuzzyLexicon(self.words, self.stems))
        low = text.lower()
        found = list(map(self._known.__getitem__, WORD.findall(low)))
        if not any(found):
            return []
        places = list(WORD.finditer(low))
        return [(places[i].group(), *hit, i, _context(low, places, i)) for i, hit in enumerate(found) if hit]

    def features(self, text: str | None, hits: list | None = None) -> list[float]:
        hits = (self.hits(text) if text else []) if hits is None else hits
        plain = sum(HIT_WORTH[e] for *_, e, _, context in hits if e < 3 and context <= 0)
        quoted = sum(HIT_WORTH[min(e, 2)] for *_, e, _, context in hits if context > 0)
        stem = sum(e == 3 and context <= 0 for *_, e, _, context in hits)
        n = len(WORD.findall(text)) if hits else 0
        return [math.log1p(plain), math.log1p(quoted), math.log1p(stem), min(1.0, plain + stem),
                min(5.0, 100 * (plain + stem) / n if n else 0.0)]

    def score(self, text: str | None, hits: list | None = None) -> float:
        x = self.features(text, hits)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights @ np.array(x)) + self.bias))))


def _context(low: str, places: list[re.Match], i: int) -> float:
    """Evidence for quotation (above 0) or abuse (below) around a hit."""
    lo, hi = max(0, i - CONTEXT_WORDS), min(len(places) - 1, i + CONTEXT_WORDS)
    before = low[places[lo].start():places[i].start() + 1]
    after = low[places[i].end() - 1:places[hi].end() + 1]
    quoted = _quoted(before, after)
    around = [places[j].group() for j in range(lo, hi + 1) if j != i]
    return 2.0 * quoted + 0.75 * any(w in REPORTING for w in around) - 1.0 * any(w in ADDRESS for w in around) - 0.5


def _quoted(before: str, after: str) -> bool:
    """Does a quotation open in ``before`` and close in ``after``? Both begin
    or end with a letter of the hit, so that an apostrophe within a word (a
    letter on both sides) is known as one."""
    before, after = _APOSTROPHE.sub("", before), _APOSTROPHE.sub("", after)
    return any(m in QUOTES and any(c in after for c in QUOTES[m]) for m in before)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sample that the model is fitted on: (text, toxic). Of copies and
    near copies (equal smallest hash of the three-word runs) one row teaches."""
    known = labels.select("doc_id", F.col("toxic").alias("__toxic")).where("__toxic is not null") \
        .where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    # the share with the lowest hashes of all labelled rows of ``docs``; the
    # filter stands below the join, so only the sample's texts move
    n = docs.select("doc_id").join(known, "doc_id").count()
    if n > FIT_ROWS:
        known = known.where(F.xxhash64("doc_id") < F.lit(int(FIT_SHARE * FIT_ROWS / n * 2 ** 64) - 2 ** 63))
    rows = docs.select("doc_id", "text").join(known, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            yield [b.column(0), b.column(1), b.column(2), [_smallest_run(t) for t in b.column(1).to_pylist()]]

    marked = stored(map_batches(rows.select(F.col("doc_id").cast("long"), "text", F.col("__toxic").cast("int")),
                                "doc_id long, text string, toxic int, run long", run), "toxic-sample")
    first = stored(marked.groupBy("run", "toxic").agg(F.min("doc_id").alias("doc_id")), "toxic-first")
    return marked.join(first, ["run", "toxic", "doc_id"], "left_semi").select("text", "toxic").repartition(
        max(2, docs.sparkSession.sparkContext.defaultParallelism))


def _smallest_run(text: str | None) -> int:
    raw, off = text_bytes(pa.array([text], pa.string()))
    starts, ends, _ = word_bounds(raw, off)
    words = hash_words(raw, starts, ends)
    runs = gram_hashes(words, 3) if len(words) >= 3 else words
    return int(runs.min().astype(np.uint64).view(np.int64)) if len(runs) else 0


def learn_lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems that mark toxic texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            texts: Counter = Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in set(WORD.findall((text or "").lower())):
                    texts[w, y] += 1
            yield [[w for w, _ in texts], [n * y for (_, y), n in texts.items()], [n * (1 - y) for (_, y), n in texts.items()]]

    by_word = stored(map_batches(rows.select("text", "toxic"), "word string, bad long, good long", run).groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxic-words")

    toxic = rows.where("toxic = 1").count()

    def chosen(counts: DataFrame) -> DataFrame:
        return counts.where(F.col("bad") >= max(MIN_TEXTS, MIN_SPREAD * toxic)).where(F.col("bad") >= MIN_SHARE * (F.col("bad") + F.col("good")))

    stems = by_word.where(F.length("word") >= min(STEM_LENGTHS)).select(
        F.explode(F.array(*[F.substring("word", 1, n) for n in STEM_LENGTHS])).alias("stem"), "word", "bad", "good")
    stems = stems.distinct().groupBy("stem").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words"), F.max("bad").alias("top"))
    stems = chosen(stems).where(F.col("words") >= STEM_WORDS).where(F.col("top") <= STEM_TOP * F.col("bad"))
    kept = outer_stems({r["stem"]: r["bad"] for r in stems.collect()})
    words = [r["word"] for r in chosen(by_word).where(F.length("word") >= 3).orderBy(F.desc("bad"), "word").collect()]
    begun = set(kept)
    return [w for w in words if not any(w[:n] in begun for n in STEM_LENGTHS)], kept


def outer_stems(marked: dict[str, int]) -> list[str]:
    """Of nested stems the longest one that keeps what a shorter one marks;
    then none that begins with another."""
    order, best = sorted(marked), []
    for i, s in enumerate(order):
        longer = itertools.takewhile(lambda t: t.startswith(s), itertools.islice(order, i + 1, None))
        if not any(marked[t] >= 0.98 * marked[s] for t in longer):
            best.append(s)
    kept: list[str] = []
    for s in best:  # in order: what begins with a stem follows it
        if not kept or not s.startswith(kept[-1]):
            kept.append(s)
    return sorted(kept, key=lambda s: (len(s), s))


def _checked_edits(rows: DataFrame, words: list[str]) -> dict[str, int]:
    """The edits each lexicon word may allow: as many as its length does, but
    fewer where what they find in the training rows is not toxic."""
    trial = ToxicityModel({w: edits_for(w) for w in words}, [], PRIOR, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            seen: Counter = Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for term, edits in {(t, e) for _, t, e, _, _ in trial.hits(text or "") if e}:
                    seen[term, edits, y] += 1
            yield [[k[0] for k in seen], [k[1] for k in seen], [n * k[2] for k, n in seen.items()],
                   [n * (1 - k[2]) for k, n in seen.items()]]

    got = map_batches(rows.select("text", "toxic"), "term string, edits int, bad long, good long", run).groupBy(
        "term", "edits").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    out = dict(trial.words)
    for r in got:
        if r["good"] and r["bad"] < MIN_SHARE * (r["bad"] + r["good"]):
            out[r["term"]] = min(out[r["term"]], r["edits"] - 1)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    rows = training_rows(docs, labels)
    n = rows.groupBy("toxic").count().collect()
    counts = {r["toxic"]: r["count"] for r in n}
    if not counts.get(0) or not counts.get(1):
        share = 1 - 1e-9 if counts.get(1) else 1e-9
        return ToxicityModel({}, [], np.zeros(len(PRIOR)), math.log(share / (1 - share)))
    words, stems = learn_lexicon(rows)
    model = ToxicityModel(_checked_edits(rows, words), stems, PRIOR.copy(), -3.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            yield [[model.features(t) for t in b.column(0).to_pylist()], b.column(1)]

    got = map_batches(rows.select("text", "toxic"), "x array<double>, y int", run).toPandas()
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])                       # the same sums in every run
    model.weights, model.bias = _logistic(x[order], y[order])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic model drawn to ``PRIOR``."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(PRIOR, -3.0)
    w, pull = prior.copy(), np.full(len(prior), ridge)
    pull[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(pull), grad)
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def scorer(model: ToxicityModel):
    """A pandas UDF from texts to scores."""
    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return toxicity


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, hits (word, term, edits, place,
    context) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            texts = b.column(1).to_pylist()
            hits = [model.hits(t) if t else [] for t in texts]
            part = lambda i: [[h[i] for h in hs] for hs in hits]
            yield [b.column(0), [model.score(t, h) for t, h in zip(texts, hits)], part(0), part(1), part(2), part(3), part(4)]

    got = map_batches(docs.select("doc_id", "text"), "doc_id long, score double, word array<string>, term array<string>, "
                      "edits array<int>, place array<long>, context array<double>", run)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      F.arrays_zip("word", "term", "edits", "place", "context").alias("hits"))

