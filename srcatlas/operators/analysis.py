"""Per-repository code analysis over chunks and documents.

Facts are extracted per chunk (narrow), then aggregated per repository
with partial (map-side) aggregation, so one very large repository is
spread over every task before the shuffle. Unbounded lists (functions,
classes, imports, endpoints) are returned long: one row per (repo, item),
never collected into one array. Sets drawn from fixed label lists
(languages, frameworks) become one boolean per label, so no collect is
needed at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import codefacts as cf


def chunk_facts(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its extracted facts. Framework presence is one
    0/1 column per pattern and endpoints are counted by array sizes, so the
    projection has no lambda functions and stays in generated code."""
    lc = F.lower(F.col("content"))
    base = chunks.select("repo_id", "chunk_id", "doc_id", "chunk_num", "source_file", "content", lc.alias("_lc"))
    return base.select(
        "repo_id", "chunk_id", "doc_id", "chunk_num", "source_file",
        cf.functions("content").alias("functions"),
        cf.classes("content").alias("classes"),
        cf.endpoint_count("content").alias("n_endpoints"),
        *cf.framework_flags(F.col("_lc")),
        F.col("_lc").contains("langchain").alias("has_langchain"),
        F.col("_lc").contains("ollama").alias("has_ollama"),
        (F.col("_lc").contains("cli") | F.col("_lc").contains("command")).alias("has_cli_word"),
    )


def _sorted_set(labels: list[str], unknown: str = "Unknown") -> Column:
    """Joined sorted label set from the ``has_i`` flags (``Unknown`` when empty)."""
    order = sorted(range(len(labels)), key=lambda i: labels[i])
    arr = F.array_compact(F.array(*[F.when(F.col(f"has_{i}") == 1, F.lit(labels[i])) for i in order]))
    return F.when(F.size(arr) == 0, F.array(F.lit(unknown))).otherwise(arr)


def repo_languages(documents: DataFrame, table: dict[str, str] = K.LANGUAGES) -> DataFrame:
    """repo_id -> sorted languages of its files (``['Unknown']`` when none)."""
    labels = sorted(set(table.values()))
    lang = cf.language("file_path", table)
    flags = documents.groupBy("repo_id").agg(*[F.max((lang == F.lit(l)).cast("int")).alias(f"has_{i}") for i, l in enumerate(labels)])
    return flags.select("repo_id", _sorted_set(labels).alias("languages"))


def repo_frameworks(chunks: DataFrame, patterns: dict[str, str] = K.FRAMEWORKS, word_boundary: bool = False) -> DataFrame:
    """repo_id -> sorted framework labels; with ``word_boundary`` a pattern
    counts as a whole word only ("reaction" is not React)."""
    labels = list(patterns.values())
    lc = chunks.select("repo_id", F.lower("content").alias("_lc"))
    flags = lc.select("repo_id", *cf.framework_flags(F.col("_lc"), patterns, word_boundary)) \
        .groupBy("repo_id").agg(*[F.max(f"fw_{i}").alias(f"has_{i}") for i in range(len(labels))])
    return flags.select("repo_id", _sorted_set(labels).alias("frameworks"))


def key_functions(chunks: DataFrame) -> DataFrame:
    """(repo_id, name, n): every function definition found, counted per chunk."""
    return (chunks.select("repo_id", F.explode(cf.functions("content")).alias("name"))
            .groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("n")))


def key_classes(chunks: DataFrame) -> DataFrame:
    return (chunks.select("repo_id", F.explode(cf.classes("content")).alias("name"))
            .groupBy("repo_id", "name").agg(F.count(F.lit(1)).alias("n")))


def repo_imports(chunks: DataFrame) -> DataFrame:
    """Distinct (repo_id, import): the ``from`` module when present and the
    first comma part of the imported names, stripped."""
    from ..functions.text import strip
    t = F.col("content")
    pairs = chunks.select("repo_id", F.explode(F.arrays_zip(
        F.regexp_extract_all(t, F.lit(K.IMPORT_RE), 1).alias("m"),
        F.regexp_extract_all(t, F.lit(K.IMPORT_RE), 2).alias("n"))).alias("p"))
    items = pairs.select("repo_id", F.explode(F.array(
        F.when(F.col("p.m") != "", F.col("p.m")), strip(F.split(F.col("p.n"), ",", 2)[0]))).alias("import_name"))
    return items.where(F.col("import_name").isNotNull()).distinct()


def api_endpoints(chunks: DataFrame) -> DataFrame:
    """(repo_id, method, path, n); method is NULL for plain routes."""
    t = F.col("content")
    routes = chunks.select("repo_id", F.lit(None).cast("string").alias("method"),
                           F.explode(F.regexp_extract_all(t, F.lit(K.ROUTE_RE), 1)).alias("path"))
    parts = [routes]
    for pattern in (K.ROUTER_RE, K.APP_METHOD_RE):
        z = chunks.select("repo_id", F.explode(F.arrays_zip(
            F.regexp_extract_all(t, F.lit(pattern), 1).alias("m"),
            F.regexp_extract_all(t, F.lit(pattern), 2).alias("p"))).alias("z"))
        parts.append(z.select("repo_id", F.col("z.m").alias("method"), F.col("z.p").alias("path")))
    e = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return e.groupBy("repo_id", "method", "path").agg(F.count(F.lit(1)).alias("n"))


def _facts_aggs(fw_labels: list[str]) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.size("classes")).cast("bigint").alias("n_classes"),
        F.sum(F.size("functions")).cast("bigint").alias("n_functions"),
        F.sum("n_endpoints").cast("bigint").alias("n_endpoints"),
        F.max(F.array_contains("functions", F.lit("main")).cast("int")).alias("has_main"),
        F.max(F.col("has_langchain").cast("int")).alias("has_langchain"),
        F.max(F.col("has_ollama").cast("int")).alias("has_ollama"),
        F.max(F.col("has_cli_word").cast("int")).alias("has_cli_word"),
        *[F.max(f"fw_{i}").alias(f"has_{i}") for i in range(len(fw_labels))],
    ]


def _facts_select(agg: DataFrame, fw_labels: list[str], extra: list[str] = ()) -> DataFrame:
    frameworks = _sorted_set(fw_labels)
    idx = {l: i for i, l in enumerate(fw_labels)}

    def any_of(names: list[str]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | (F.col(f"has_{idx[n]}") == 1)
        return out

    arch = cf.architecture(
        any_of(K.WEB_FRAMEWORKS), any_of(K.FRONTEND_FRAMEWORKS),
        F.col("has_langchain") == 1, F.col("has_ollama") == 1, any_of(K.ML_FRAMEWORKS),
        F.col("has_cli_word") == 1, F.col("n_classes"), F.col("has_main") == 1)
    return agg.select("repo_id", "n_chunks", "n_classes", "n_functions", "n_endpoints",
                      (F.col("has_main") == 1).alias("has_main"),
                      frameworks.alias("frameworks"), arch.alias("architecture_type"), *extra)


def repo_facts(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per repository: counts, flags, framework/language sets, architecture."""
    fw_labels = list(K.FRAMEWORKS.values())
    agg = chunk_facts(chunks).groupBy("repo_id").agg(*_facts_aggs(fw_labels))
    out = _facts_select(agg, fw_labels)
    if documents is not None:
        out = out.join(repo_languages(documents), "repo_id", "left")
        out = out.withColumn("languages", F.coalesce("languages", F.array(F.lit("Unknown"))))
    return out


def document_counts(documents: DataFrame) -> DataFrame:
    """Per-repo counts of classes, functions and endpoints found in whole
    documents: names once a document, and nothing twice because chunks
    overlap."""
    names = lambda found: F.size(F.array_distinct(found)).cast("bigint")
    return documents.groupBy("repo_id").agg(
        F.sum(names(cf.classes("content"))).alias("document_classes_count"),
        F.sum(names(cf.functions("content"))).alias("document_functions_count"),
        F.sum(cf.endpoint_count("content")).cast("bigint").alias("document_endpoints_count"))


def analysis_summary(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Per-repo counts of classes, functions, endpoints (with repeats, as
    found per chunk) and distinct imports; dependencies are never filled. With
    ``documents`` also the counts per document (``document_counts``)."""
    facts = chunk_facts(chunks)
    counts = facts.groupBy("repo_id").agg(
        F.sum(F.size("classes")).cast("bigint").alias("key_classes_count"),
        F.sum(F.size("functions")).cast("bigint").alias("key_functions_count"),
        F.sum("n_endpoints").cast("bigint").alias("api_endpoints_count"))
    imps = repo_imports(chunks).groupBy("repo_id").agg(F.count(F.lit(1)).alias("imports_count"))
    out = counts.join(imps, "repo_id", "left").select(
        "repo_id", "key_classes_count", "key_functions_count", "api_endpoints_count",
        F.coalesce("imports_count", F.lit(0)).cast("bigint").alias("imports_count"),
        F.lit(0).cast("bigint").alias("dependencies_count"))
    return out if documents is None else out.join(document_counts(documents), "repo_id", "left")


def categorize(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("category", cf.category("source_file"))


def category_counts(chunks: DataFrame) -> DataFrame:
    return categorize(chunks).groupBy("repo_id", "category").agg(F.count(F.lit(1)).alias("n_chunks"))
