"""Text expressions (Column -> Column): hashing, previews, cleaning, reviews.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; none calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# White space as Python's ``str.strip``/``\s`` sees it, written out so the
# Java and RE2 engines agree.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = K.WORD


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Every character ``str.isspace()`` accepts, for trimming without a regex.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                    + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip(text) -> Column:
    """``str.strip()``: remove leading and trailing white space (a linear
    trim of a fixed character set, no regular expression)."""
    return F.trim(_c(text), F.lit(WHITESPACE_CHARS))


def content_hash(text) -> Column:
    return F.md5(_c(text))


def preview(text, n: int = K.PREVIEW_CHARS) -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def preprocess(text) -> Column:
    """Drop ``<...>`` tags, then turn every char that is not word, space or '-' into a space."""
    no_tags = F.regexp_replace(_c(text), r"<[^>]+>", "")
    return F.regexp_replace(no_tags, rf"[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x85\p{{Z}}-]", " ")


def safe_name(name, n: int = 50) -> Column:
    return F.substring(F.regexp_replace(_c(name), r'[<>:"/\\|?*]', "_"), 1, n)


def clean_response(text) -> Column:
    """Strip; when the text opens with a chatty preamble, cut to the first
    line that starts with '#' or a code fence (unchanged if there is none)."""
    t = strip(text)
    chatty = F.lit(False)
    for p in K.PREAMBLE_PREFIXES:
        chatty = chatty | t.startswith(p)
    lines = F.split(t, "\n", -1)
    first = F.array_min(F.array_compact(F.transform(
        lines, lambda x, i: F.when(x.startswith("#") | x.startswith("```"), i))))
    cut = F.array_join(F.slice(lines, first + 1, F.size(lines)), "\n")
    return F.when(chatty & first.isNotNull(), cut).otherwise(t)


def review_score(text, default: int = K.DEFAULT_SCORE) -> Column:
    """First number found by the score patterns, in pattern order, clamped
    to 0..100; ``default`` when no pattern matches. Exact for any digit run."""
    t = _c(text)
    digits = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in K.SCORE_PATTERNS])
    trimmed = F.regexp_replace(digits, r"^0+", "")
    value = (F.when(digits.isNull(), F.lit(default))
             .when(trimmed == "", F.lit(0))
             .when(F.length(trimmed) > 3, F.lit(100))
             .otherwise(F.least(trimmed.cast("int"), F.lit(100))))
    return value.cast("int")


def has_placeholder(text) -> Column:
    t = _c(text)
    hit = F.lit(False)
    for phrase in K.PLACEHOLDER_PHRASES:
        hit = hit | t.contains(phrase)
    return hit


def _py_repr(s: Column) -> Column:
    """``repr()`` of a one-line string, as Python prints it inside a list."""
    esc = F.regexp_replace(s, r"\\", r"\\\\")
    esc = F.regexp_replace(F.regexp_replace(esc, "\t", r"\\t"), "\r", r"\\r")
    dq = s.contains("'")
    return (F.when(dq & (~s.contains('"')), F.concat(F.lit('"'), esc, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'"))))


def placeholders(text) -> Column:
    """All ``{{...}}`` bodies, in order."""
    return F.regexp_extract_all(_c(text), F.lit(r"(?d)\{\{(.*?)\}\}"), 1)


def placeholder_report(text) -> Column:
    t = _c(text)
    found = placeholders(t)
    n = F.size(found)
    shown = F.concat(F.lit("["), F.array_join(F.transform(F.slice(found, 1, K.PLACEHOLDER_REPORT_LIMIT), _py_repr), ", "), F.lit("]"))
    first = F.when(n > 0, F.concat(F.lit("Found "), n.cast("string"), F.lit(" template placeholders: "), shown))
    issues = F.array_compact(F.array(first, *[F.when(t.contains(phrase), F.lit(desc)) for phrase, desc in K.PLACEHOLDER_ISSUES]))
    body = F.array_join(F.transform(issues, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(issues) > 0, F.concat(F.lit(K.PLACEHOLDER_REPORT_HEADER + "\n"), body)).otherwise(F.lit(K.PLACEHOLDER_REPORT_OK))


def _regex_quote(s: str) -> str:
    return r"\Q" + s + r"\E"


def fill_placeholders(text, values: dict[str, Column]) -> Column:
    """Case-insensitive literal replacement of the known placeholders.

    ``values`` maps the context field names of ``PLACEHOLDER_FILLS`` to Columns.
    ``$`` and ``\\`` in replacement values are escaped so they stay literal.
    """
    out = _c(text)
    for placeholder, field in K.PLACEHOLDER_FILLS:
        v = values[field]
        v = F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), r"\$", r"\\\$")
        out = F.regexp_replace(out, F.lit("(?i)" + _regex_quote(placeholder)), v)
    return out


def metadata_path(meta_json) -> Column:
    """``source_file`` out of a JSON metadata string, '' when absent or
    unparsable. Strict JSON: a Python-repr dict (single quotes) does not parse."""
    parsed = F.from_json(_c(meta_json), "source_file string",
                         {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.coalesce(parsed["source_file"], F.lit(""))
