"""Quality rules: decision lists learned by sequential covering, run as
ordered Spark conditional expressions.

Measures of a text are DataFrame expressions only. Rules are learned on the
labelled rows: each measure is cut at its exact quantiles over all of them,
found by counts of value bins that are narrowed where a quantile lies, and every
step of the search is one grouped count of good and bad rows for each
cut, so only (measures x cuts) totals reach the driver. A rule is a
conjunction of thresholds, grown for the best gain over the rows that no
earlier rule covers, then pruned on rows kept out of growing. Rules are
emitted in order as one CASE expression.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; without labels (or without bad ones) no rule is learned and the base
rule decides alone; rows with a null label or measure teach nothing; repeated
rows are judged each; an empty table gives an empty result; measures live in
one struct column with a name of its own, so a table's other columns do not
clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Cuts of each measure (at equal shares of the labelled rows).
CUTS = 40
#: Value bins of each measure in the first count, and of each bin that is
#: narrowed; values that are fetched rather than counted again.
CUT_BINS, NARROW_BINS, FEW_VALUES = 4096, 64, 1 << 16
#: Most thresholds of one rule, and most rules of a list.
MAX_CONDITIONS = 3
MAX_RULES = 12
#: A rule must be right for this share of the rows it covers, and cover this
#: many bad rows at least.
MIN_PRECISION = 0.97
MIN_COVERED = 8

MEASURES = "__measures"


def _free_name(df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    name, taken = MEASURES, {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in 8-word windows that stand twice or more in the text.

    Windows are compared by their 64-bit hashes, sorted with their places;
    equal neighbours are repeats. The words covered are counted from the gaps
    between the repeats' places."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)),
                          lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)

    def repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def places(s: Column) -> Column:
            m = F.size(s)
            none = F.array(F.lit(None).cast("struct<h:bigint,p:int>"))
            before = F.concat(none, F.slice(s, F.lit(1), m - 1))
            after = F.concat(F.slice(s, F.lit(2), m - 1), none)
            marked = F.zip_with(F.zip_with(s, before, lambda x, y: F.struct(
                x.getField("h").alias("h"), x.getField("p").alias("p"),
                F.coalesce(x.getField("h") == y.getField("h"), F.lit(False)).alias("r"))), after,
                lambda x, y: F.when(x.getField("r") | F.coalesce(x.getField("h") == y.getField("h"), F.lit(False)),
                                    x.getField("p")))
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            _let(pairs, lambda s: _let(places(s), covered)))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(hashes, repeats))


def measures(text: Column) -> Column:
    """A struct of a text's counts and of the measures that rules may use."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"),
                        _repeat_words(words).alias("n_repeat_words"),
                        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    def without(chars: str) -> Column:
        return F.char_length(F.translate(t, chars, ""))

    w = _let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words)
    chars = F.char_length(t)
    return F.struct(
        w.alias("w"), _let(lines, of_lines).alias("l"),
        without(SPACES).cast("long").alias("word_chars"),
        (chars - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (chars - without("0123456789")).cast("long").alias("n_digits"),
        (chars - without(".,;:!?")).cast("long").alias("n_marks"),
        (chars - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"))


def with_measures(docs: DataFrame, name: str = MEASURES) -> DataFrame:
    """``docs`` with one struct column more, of counts and shares."""
    d = docs.withColumn(name, measures(F.col("text")))
    m = F.col(name)
    n = m["w"]["n_words"]
    per_word = lambda c: F.when(n > 0, c / n)
    per_char = lambda c: F.when(m["word_chars"] > 0, c / m["word_chars"])
    failed = (n < 20) | (100 * m["w"]["n_repeat_words"] > 30 * n)
    flat = F.struct(
        n.alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        per_word(m["word_chars"]).alias("word_length"),
        per_word(m["n_symbols"]).alias("symbol_share"),
        per_word(m["w"]["n_repeat_words"]).alias("repeat_share"),
        F.when(m["l"]["n_lines"] > 0, m["l"]["n_dup_lines"] / m["l"]["n_lines"]).alias("dup_line_share"),
        per_word(m["w"]["n_distinct"]).alias("distinct_share"),
        per_char(m["n_digits"]).alias("digit_share"), per_char(m["n_marks"]).alias("mark_share"),
        per_char(m["n_capitals"]).alias("capital_share"),
        F.when(m["l"]["n_lines"] > 0, n / m["l"]["n_lines"]).alias("words_per_line"),
        n.cast("double").alias("words"))
    return d.withColumn(name, flat)


#: Measures that rules may test.
RULE_MEASURES = ("words", "word_length", "symbol_share", "repeat_share", "dup_line_share", "distinct_share",
                 "digit_share", "mark_share", "capital_share", "words_per_line")


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self, of) -> Column:
        c = of(self.measure)
        hit = c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered_bad: int
    covered_good: int

    def column(self, of) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(of)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{c.measure} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def rejects(rules: list[Rule], of) -> Column:
    """The list as one ordered conditional: the number of the first rule that
    covers a row (from 1), 0 if none does."""
    out = F.lit(0)
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r.column(of), F.lit(i)).otherwise(out)
    return out


#: Counts that the report returns.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row, written once: what follows reads
    these few numbers, and no text moves."""
    d = with_measures(docs.select("doc_id", "text"))
    return stored(d.select("doc_id", *[F.col(MEASURES)[m].alias(m) for m in dict.fromkeys(REPORTED + RULE_MEASURES)]), "quality-measures")


def labelled(measures_of: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Measures of the labelled rows that pass the base rule, ``bad`` 1 where
    the label is 0, and ``grow`` for the two thirds that rules are grown on."""
    known = labels.select("doc_id", F.col(label).alias("__label")).where(F.col("__label").isNotNull()).dropDuplicates(["doc_id"])
    d = measures_of.where("not base_failed").join(known, "doc_id")
    return stored(d.select(
        *[F.col(m).cast("double").alias(m) for m in RULE_MEASURES], (F.col("__label") == 0).cast("int").alias("bad"),
        (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 0).alias("grow")), "quality-labelled")


def _quantiles(rows: DataFrame, shares: list[float]) -> dict[str, list[float]]:
    """What ``percentile`` gives for each measure, in bounded state: values
    are counted in bins, and only the bins that hold a wanted rank are counted
    again in finer ones, until a bin has one value or few values are left."""
    stack = ", ".join(f"'{m}', {m}" for m in RULE_MEASURES)
    # kept as they are: a null, NaN or infinite value is no value
    values = rows.select(F.expr(f"stack({len(RULE_MEASURES)}, {stack}) as (measure, v)")).where(F.abs("v") < float("inf"))
    whole = values.groupBy("measure").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    ranks = {r["measure"]: sorted({k for p in shares for k in (math.floor((r["n"] - 1) * p), math.ceil((r["n"] - 1) * p))})
             for r in whole}
    at: dict[tuple[str, int], float] = {}       # value of each wanted rank
    # (measure, lo, hi) -> values below lo, values from lo to hi
    open_ = {(r["measure"], r["lo"], r["hi"]): (0, r["n"]) for r in whole}
    bins = CUT_BINS
    while True:
        for (m, lo, hi), (below, n) in list(open_.items()):
            if lo == hi:
                at.update({(m, k): lo for k in ranks[m] if below <= k < below + n})
                del open_[m, lo, hi]
        if not open_:
            break
        # bounded: one row for each open bin, at most two for each quantile
        listed = ", ".join(f"('{m}', double('{lo!r}'), double('{hi!r}'))" for m, lo, hi in open_)
        spans = rows.sparkSession.sql(f"select * from values {listed} as t(m, lo, hi)")
        inside = values.join(F.broadcast(spans), F.expr("measure = m and v >= lo and v <= hi"))
        if sum(n for _, n in open_.values()) <= FEW_VALUES:
            got: dict[tuple[str, float, float], list[float]] = {}
            for r in inside.select("m", "lo", "hi", "v").collect():
                got.setdefault((r["m"], r["lo"], r["hi"]), []).append(r["v"])
            for key, (below, n) in open_.items():
                held = sorted(got[key])
                at.update({(key[0], k): held[k - below] for k in ranks[key[0]] if below <= k < below + n})
            break
        number = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = inside.groupBy("m", "lo", "hi", number.alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        narrowed = {}
        below, before = 0, None
        for r in sorted(counts, key=lambda r: (r["m"], r["lo"], r["hi"], r["bin"])):
            if before != (key := (r["m"], r["lo"], r["hi"])):
                below, before = open_[key][0], key
            if any(below <= k < below + r["n"] for k in ranks[r["m"]]):
                narrowed[r["m"], r["least"], r["most"]] = (below, r["n"])
            below += r["n"]
        open_, bins = narrowed, NARROW_BINS
    out = {}
    for r in whole:
        m, out[r["measure"]] = r["measure"], []
        for p in shares:
            place = (r["n"] - 1) * p
            a, b = math.floor(place), math.ceil(place)
            x, y = at[m, a], at[m, b]
            out[m].append(x if a == b or x == y else (b - place) * x + (place - a) * y)
    return out


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    got = _quantiles(rows, [i / CUTS for i in range(1, CUTS)])
    out = {}
    for m in RULE_MEASURES:
        values = sorted({float(v) for v in got.get(m, ())})
        # also halfway between two quantiles that lie far apart
        out[m] = sorted({*values, *((a + b) / 2 for a, b in zip(values, values[1:]))})
    return out


def learn(rows: DataFrame) -> list[Rule]:
    """Sequential covering over labelled measures (see ``labelled``)."""
    cuts = _cuts(rows)
    # bin of a row: how many cuts lie below its value; counts of bins give
    # the counts of every threshold by adding up
    binned = rows.select(
        "bad", "grow", *RULE_MEASURES,
        *[F.when(F.col(m).isNotNull(), sum((F.when(F.col(m) > F.lit(t), 1).otherwise(0) for t in cuts[m]), F.lit(0))).alias(f"b_{m}")
          for m in RULE_MEASURES])
    binned = stored(binned, "quality-binned")
    of = F.col
    rules: list[Rule] = []
    open_ = F.lit(True)
    for _ in range(MAX_RULES):
        rest = binned.where(open_)
        grown: list[Condition] = []
        for _ in range(MAX_CONDITIONS):
            step = _best_condition(rest.where("grow"), grown, cuts)
            if step is None:
                break
            grown.append(step[0])
            if step[1] == 0:                    # covers no good row any more
                break
        rule = _pruned(rest, grown) if grown else None
        if rule is None:
            break
        rules.append(rule)
        open_ = open_ & ~rule.column(of)
    return rules


def _best_condition(rows: DataFrame, so_far: list[Condition], cuts) -> tuple[Condition, int] | None:
    """The threshold with the best gain within ``so_far``, and the good rows
    it still covers."""
    for c in so_far:
        rows = rows.where(c.column(F.col))
    stack = ", ".join(f"'{m}', b_{m}" for m in RULE_MEASURES)
    counts = rows.select("bad", F.expr(f"stack({len(RULE_MEASURES)}, {stack}) as (measure, bin)")).where("bin is not null") \
        .groupBy("measure", "bin").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["measure"], {})[r["bin"]] = (r["bad"], r["good"])
    best, ties = None, []
    for m in RULE_MEASURES:
        bins = by.get(m, {})
        bad, good = sum(b for b, _ in bins.values()), sum(g for _, g in bins.values())
        if not bad or not good:
            continue
        low_b = low_g = 0
        for i, t in enumerate(cuts[m]):
            b, g = bins.get(i, (0, 0))
            low_b, low_g = low_b + b, low_g + g
            for above, p, n in ((False, low_b, low_g), (True, bad - low_b, good - low_g)):
                if p < MIN_COVERED or p + n == bad + good:
                    continue
                # information gained for each bad row that stays covered
                gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                key = (gain, p, -RULE_MEASURES.index(m), not above)
                if gain > 1e-9 and (best is None or key > best):
                    best, ties = key, []
                if key == best:
                    ties.append((Condition(m, above, t), n))
    # cuts that part the rows alike: the middle one keeps clear of both sides
    return ties[len(ties) // 2] if ties else None


def _pruned(rows: DataFrame, grown: list[Condition]) -> Rule | None:
    """The prefix of ``grown`` that does best on the rows kept out, if it is
    precise enough on both parts."""
    sums = []
    cond = F.lit(True)
    for i, c in enumerate(grown):
        cond = cond & c.column(F.col)
        for part, where in (("g", F.col("grow")), ("k", ~F.col("grow"))):
            sums += [F.sum(F.when(cond & where, F.col("bad")).otherwise(0)).alias(f"{part}b{i}"),
                     F.sum(F.when(cond & where, 1 - F.col("bad")).otherwise(0)).alias(f"{part}g{i}")]
    got = rows.agg(*sums).first()
    best = None
    for i in range(len(grown)):
        kb, kg, gb, gg = (got[f"{x}{i}"] or 0 for x in ("kb", "kg", "gb", "gg"))
        precise = min((kb + 1) / (kb + kg + 1), gb / max(1, gb + gg))
        if kb + gb < MIN_COVERED or precise < MIN_PRECISION:
            continue
        worth = (kb - kg) / max(1, kb + kg) * math.log1p(kb + gb)
        if best is None or worth > best[0]:
            best = (worth, Rule(tuple(grown[:i + 1]), kb + gb, kg + gg))
    return best and best[1]


def quality_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    return learn(labelled(measured(docs), labels))


def judge(measures_of: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, ``base_failed``, the first ``rule`` that rejects
    (0: none) and ``kept``, for every row of ``measured``."""
    d = measures_of.withColumn("rule", rejects(rules, F.col))
    return d.select("doc_id", *REPORTED, "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and judge all of them."""
    m = measured(docs)
    return judge(m, learn(labelled(m, labels)))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; no shuffle."""
    name = _free_name(docs)
    of = lambda m: F.col(name)[m]
    d = with_measures(docs, name)
    return d.where(~of("base_failed") & (rejects(rules, of) == 0)).drop(name)
