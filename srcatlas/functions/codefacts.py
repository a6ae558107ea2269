"""Code-fact expressions over one chunk of text (Column -> Column).

Each returns an array for the chunk; operators aggregate them per repository.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import paths
from .text import strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def functions(text) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(K.FUNCTION_RE), 1)


def classes(text) -> Column:
    # (?d): '.' stops only at '\n', as in Python.
    return F.regexp_extract_all(_c(text), F.lit("(?d)" + K.CLASS_RE), 1)


def imports(text) -> Column:
    """Imported names: the ``from`` module when present, and the first
    comma-separated part of what follows ``import``, stripped."""
    t = _c(text)
    mods = F.regexp_extract_all(t, F.lit(K.IMPORT_RE), 1)
    names = F.regexp_extract_all(t, F.lit(K.IMPORT_RE), 2)
    pairs = F.arrays_zip(mods.alias("m"), names.alias("n"))
    per_match = F.transform(pairs, lambda p: F.array(
        F.when(p["m"] != "", p["m"]), strip(F.split(p["n"], ",", 2)[0])))
    return F.array_compact(F.flatten(per_match))


def endpoints(text) -> Column:
    """API endpoints as ``ARRAY<STRUCT<method STRING, path STRING>>``; a route has no method."""
    t = _c(text)
    routes = F.transform(F.regexp_extract_all(t, F.lit(K.ROUTE_RE), 1),
                         lambda p: F.struct(F.lit(None).cast("string").alias("method"), p.alias("path")))

    def with_method(pattern: str) -> Column:
        ms = F.regexp_extract_all(t, F.lit(pattern), 1)
        ps = F.regexp_extract_all(t, F.lit(pattern), 2)
        return F.transform(F.arrays_zip(ms.alias("m"), ps.alias("p")),
                           lambda x: F.struct(x["m"].alias("method"), x["p"].alias("path")))

    return F.concat(routes, with_method(K.ROUTER_RE), with_method(K.APP_METHOD_RE))


def frameworks(text, patterns: dict[str, str] = K.FRAMEWORKS) -> Column:
    """Framework labels whose lower-case pattern occurs in the text."""
    lc = F.lower(_c(text))
    return F.array_compact(F.array(*[F.when(lc.contains(p), F.lit(label)) for p, label in patterns.items()]))


def framework_flags(lower_text: Column, patterns: dict[str, str] = K.FRAMEWORKS, word_boundary: bool = False) -> list[Column]:
    """One 0/1 column per framework pattern over already lower-cased text
    (no arrays, no lambdas: stays in generated code). With ``word_boundary``
    no letter, digit or underscore may stand beside the pattern."""
    def found(p: str) -> Column:
        whole = lower_text.rlike(whole_word(p))
        return lower_text.contains(p) & whole if word_boundary else lower_text.contains(p)

    return [found(p).cast("int").alias(f"fw_{i}") for i, p in enumerate(patterns)]


def whole_word(pattern: str) -> str:
    return f"(^|[^a-z0-9_]){re.escape(pattern)}($|[^a-z0-9_])"


def endpoint_count(text) -> Column:
    t = _c(text)
    return (F.size(F.regexp_extract_all(t, F.lit(K.ROUTE_RE), 1))
            + F.size(F.regexp_extract_all(t, F.lit(K.ROUTER_RE), 1))
            + F.size(F.regexp_extract_all(t, F.lit(K.APP_METHOD_RE), 1)))


def language(path, table: dict[str, str] = K.LANGUAGES) -> Column:
    """Language of a file from its lower-case extension (NULL when unknown)."""
    m = F.create_map(*[x for kv in table.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.element_at(m, paths.ext(path))


def category(path) -> Column:
    """Chunk category from its source file: tests > requirements > docs > config > code > other."""
    p = F.coalesce(_c(path), F.lit(""))
    name = F.lower(paths.base_name(p))
    e = paths.ext(p)
    return (F.when(p == "", F.lit("other"))
            .when(name.contains("test") | name.contains("spec"), F.lit("tests"))
            .when(name.isin(*K.REQUIREMENT_FILES), F.lit("requirements"))
            .when(e.isin(*K.DOCS_EXT) | name.contains("readme"), F.lit("docs"))
            .when(e.isin(*K.CONFIG_EXT), F.lit("config"))
            .when(e.isin(*K.CODE_EXT), F.lit("code"))
            .otherwise(F.lit("other")))


def architecture(has_web: Column, has_frontend: Column, has_langchain: Column, has_ollama: Column,
                 has_ml: Column, has_cli_word: Column, n_classes: Column, has_main: Column) -> Column:
    """Ordered decision list over per-repository facts."""
    return (F.when(has_web, F.lit(K.ARCH_WEB))
            .when(has_frontend, F.lit(K.ARCH_FRONTEND))
            .when(has_langchain & has_ollama, F.lit(K.ARCH_AI))
            .when(has_ml, F.lit(K.ARCH_ML))
            .when(has_cli_word, F.lit(K.ARCH_CLI))
            .when(n_classes > K.OO_CLASS_THRESHOLD, F.lit(K.ARCH_OO))
            .when(has_main, F.lit(K.ARCH_APP))
            .otherwise(F.lit(K.ARCH_LIB)))
