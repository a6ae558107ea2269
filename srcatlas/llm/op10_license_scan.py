"""Licence scans: fuzzy search for short licence notices.

A notice of at most ``k`` edits is cut into k+1 seeds: by the pigeonhole
principle one seed of every true match stands in the text unchanged. An
Aho-Corasick automaton over all seeds finds the candidate places in one pass;
around each place the ``regex`` library's bounded-error matching verifies the
edits and gives the span. Work is per document, so there is no shuffle.

Defined results: a null text counts as empty; an empty text has no words, no
hits, empty labels and score 0; repeated rows and ties are scored row by row;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read,
so other columns, whatever their names, do not matter. A null ``doc_id``
stays null.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, transposed

#: Phrases whose exact places are counted, and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Opening words of public licence notices, lower case, words
#: only, with the label each one stands for.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("apache license version 2 0 january 2004", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("mozilla public license version 2 0", "mpl"),
    ("eclipse public license version 2 0", "epl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("boost software license version 1 0", "boost"),
    ("spdx license identifier", "spdx"),
)

#: Characters of a notice for each edit allowed (so 12 to 23 characters: one
#: edit); a seed of a notice is never shorter than half of this.
CHARS_PER_EDIT = 14
_NOT_WORD = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = {c: c + 32 for c in range(65, 91)}

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, label array<string>, start array<int>, end array<int>, edits array<int>")


def normal_form(text: str | None) -> str:
    """Lower-case words joined by single spaces, a space at either end."""
    if not text:
        return " "
    words = _NOT_WORD.sub(" ", text.translate(_UPPER) if not text.isascii() else text.lower()).strip(" ")
    return f" {words} " if words else " "


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int

    def seeds(self) -> list[tuple[int, str]]:
        """(place in the notice, seed): edits + 1 pieces that cover it."""
        n, k = len(self.text), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def _compiled(notices: tuple[tuple[str, str], ...], chars_per_edit: int):
    """The automaton over all seeds and each notice's bounded-error pattern;
    built once a worker. A shared seed leads to all its notices."""
    import ahocorasick
    import regex

    made = [Notice(t, label, len(t) // chars_per_edit) for t, label in notices]
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(made):
        for at, seed in notice.seeds():
            seeds.setdefault(seed, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for seed, places in seeds.items():
        automaton.add_word(seed, (len(seed), places))
    automaton.make_automaton()
    # best match first, then the longest run of the notice itself
    patterns = [regex.compile(f"(?b)(?:{regex.escape(x.text, special_only=True, literal_spaces=True)}){{e<={x.edits}}}") for x in made]
    return made, automaton, patterns


def _candidate_windows(norm: str, made: list[Notice], automaton) -> dict[int, list[tuple[int, int]]]:
    """For each notice the windows that its seeds ask for. The seeds of one
    copy ask for nearly the same one, so windows that begin within twice the
    edits of each other are one; none is longer than the notice and a few
    times its edits, however close copies stand."""
    begins: dict[int, list[int]] = {}
    for end, (length, places) in automaton.iter(norm):
        for i, at in places:
            begins.setdefault(i, []).append(max(0, end + 1 - length - at - made[i].edits))
    out: dict[int, list[tuple[int, int]]] = {}
    for i, starts in begins.items():
        k, n, spans = made[i].edits, len(made[i].text), []
        for lo in sorted(starts):
            hi = min(len(norm), lo + n + 3 * k)
            if spans and lo <= spans[-1][0] + 2 * k:
                spans[-1] = (spans[-1][0], hi)
            else:
                spans.append((lo, hi))
        out[i] = spans
    return out


def _best_apart(pattern, norm: str, windows: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start, end, edits) of matches that do not overlap: those with the
    fewest edits first, then the leftmost. A window whose match overlaps one
    that is taken is searched again on both sides of that."""
    todo: list[tuple[int, int, int, int, int]] = []

    def look(lo: int, hi: int) -> None:
        if hi - lo >= least and (m := pattern.search(norm, lo, hi)) is not None:
            heapq.heappush(todo, (sum(m.fuzzy_counts), m.start(), m.end(), lo, hi))

    for lo, hi in windows:
        look(lo, hi)
    starts: list[int] = []
    taken: list[tuple[int, int, int]] = []
    while todo:
        edits, s, e, lo, hi = heapq.heappop(todo)
        at = bisect.bisect_left(starts, e)
        if at and taken[at - 1][1] > s:
            s, e, _ = taken[at - 1]
        else:
            starts.insert(at, s)
            taken.insert(at, (s, e, edits))
        look(lo, min(hi, s))
        look(max(lo, e), hi)
    return taken


def find_notices(norm: str, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of every place in ``norm`` that is within a
    notice's edits of it, leftmost first. The work grows with the text and the
    number of candidates, not with how close they stand."""
    made, automaton, patterns = _compiled(tuple(notices), chars_per_edit)
    found = [(made[i].label, *span) for i, windows in _candidate_windows(norm, made, automaton).items()
             for span in _best_apart(patterns[i], norm, windows, max(1, len(made[i].text) - made[i].edits))]
    return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def scan_text(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans (places in the normal form) of one text."""
    norm = normal_form(text)
    n_words = norm.count(" ") - 1 if len(norm) > 1 else 0
    n_base, first, last, base = 0, None, None, set()
    for phrase, label in BASE_PHRASES:
        key, at = f" {phrase} ", -1
        words, seen = 0, 0
        while (at := norm.find(key, at + 1)) >= 0:
            words += norm.count(" ", seen, at)
            seen = at
            n_base += 1
            first = words if first is None else min(first, words)
            last = words if last is None else max(last, words)
            base.add(label)
    spans = find_notices(norm)
    # one minus the smallest share of edits: 1 for a notice found unchanged
    lengths = [1 - 2 * edits / max(1, e - s) for _, s, e, edits in spans]
    score = max([1.0 if base else 0.0, *lengths])
    return (n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})),
            min(1.0, max(0.0, score)), spans)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): exact phrase places,
    labels, score and the verified spans of all notices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            rows = [(d, *scan_text(t)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            flat = [(*r[:-1], *([s[i] for s in r[-1]] for i in range(4))) for r in rows]
            yield transposed(flat, 12)

    found = map_batches(docs.select("doc_id", "text"), SCHEMA, run)
    spans = F.arrays_zip("label", "start", "end", "edits").alias("spans")
    return found.select(*found.columns[:8], spans)
