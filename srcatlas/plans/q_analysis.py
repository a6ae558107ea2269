"""Queries: code facts and per-repository analysis (O34-O41, O85-O87)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import codefacts as cf
from ..operators import analysis as an
from . import duck as D
from . import inputs as I
from .registry import query

R = D.q


def _lang_case(p: str) -> str:
    return "CASE " + " ".join(f"WHEN {D.ext(p)} = {R(e)} THEN {R(l)}" for e, l in K.LANGUAGES.items()) + " END"


def _set_sql(flags: list[tuple[str, str]]) -> str:
    """Sorted joined labels from (sql_condition, label) pairs; 'Unknown' when none."""
    arr = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {R(l)} END" for c, l in flags) + "], lambda x: x IS NOT NULL))"
    return f"CASE WHEN len({arr}) = 0 THEN 'Unknown' ELSE array_to_string({arr}, ', ') END"


def _fw_flags_sql(src: str = "code_chunks") -> str:
    cols = ", ".join(f"bool_or(contains(lower(content), {R(p)})) AS fw_{i}" for i, p in enumerate(K.FRAMEWORKS))
    return f"SELECT repo_id, {cols} FROM {src} GROUP BY repo_id"


def _fw_set_sql() -> str:
    return _set_sql([(f"fw_{i}", l) for i, l in enumerate(K.FRAMEWORKS.values())])


def _lang_set_sql() -> str:
    labels = sorted(set(K.LANGUAGES.values()))
    return _set_sql([(f"bool_or(lang = {R(l)})", l) for l in labels])


def _functions_sql(src: str = "code_chunks") -> str:
    return f"SELECT repo_id, chunk_id, regexp_extract_all(content, {R(K.FUNCTION_RE)}, 1) AS fns, regexp_extract_all(content, {R(K.CLASS_RE)}, 1) AS cls FROM {src}"


def _imports_sql(src: str = "code_chunks") -> str:
    return f"""SELECT DISTINCT repo_id, item AS import_name FROM (
  SELECT repo_id, unnest([CASE WHEN m <> '' THEN m END, {D.strip("split_part(n, ',', 1)")}]) AS item FROM (
    SELECT repo_id, unnest(regexp_extract_all(content, {R(K.IMPORT_RE)}, 1)) AS m,
                    unnest(regexp_extract_all(content, {R(K.IMPORT_RE)}, 2)) AS n FROM {src}))
WHERE item IS NOT NULL"""


def _endpoints_sql(src: str = "code_chunks") -> str:
    def two(p):
        return (f"SELECT repo_id, unnest(regexp_extract_all(content, {R(p)}, 1)) AS method, "
                f"unnest(regexp_extract_all(content, {R(p)}, 2)) AS path FROM {src}")
    return (f"SELECT repo_id, CAST(NULL AS VARCHAR) AS method, unnest(regexp_extract_all(content, {R(K.ROUTE_RE)}, 1)) AS path FROM {src} "
            f"UNION ALL {two(K.ROUTER_RE)} UNION ALL {two(K.APP_METHOD_RE)}")


def _arch_sql() -> str:
    fw = list(K.FRAMEWORKS.values())

    def any_fw(names):
        return "(" + " OR ".join(f"f.fw_{fw.index(n)}" for n in names) + ")"
    return f"""SELECT f.repo_id,
  CASE WHEN {any_fw(K.WEB_FRAMEWORKS)} THEN {R(K.ARCH_WEB)}
       WHEN {any_fw(K.FRONTEND_FRAMEWORKS)} THEN {R(K.ARCH_FRONTEND)}
       WHEN x.has_langchain AND x.has_ollama THEN {R(K.ARCH_AI)}
       WHEN {any_fw(K.ML_FRAMEWORKS)} THEN {R(K.ARCH_ML)}
       WHEN x.has_cli THEN {R(K.ARCH_CLI)}
       WHEN x.n_classes > {K.OO_CLASS_THRESHOLD} THEN {R(K.ARCH_OO)}
       WHEN x.has_main THEN {R(K.ARCH_APP)} ELSE {R(K.ARCH_LIB)} END AS architecture_type,
  x.n_classes, x.n_functions, x.has_main
FROM fw f JOIN (
  SELECT c.repo_id, bool_or(contains(lower(c.content), 'langchain')) AS has_langchain,
    bool_or(contains(lower(c.content), 'ollama')) AS has_ollama,
    bool_or(contains(lower(c.content), 'cli') OR contains(lower(c.content), 'command')) AS has_cli,
    CAST(sum(len(fc.cls)) AS BIGINT) AS n_classes, CAST(sum(len(fc.fns)) AS BIGINT) AS n_functions,
    bool_or(list_contains(fc.fns, 'main')) AS has_main
  FROM code_chunks c JOIN fc ON fc.chunk_id = c.chunk_id GROUP BY c.repo_id) x ON x.repo_id = f.repo_id"""


def analysis_ctes(extra=None):
    return D.std_ctes(code=True, extra=[("fw", _fw_flags_sql()), ("fc", _functions_sql())] + (extra or []))


# --- O34, O35 -------------------------------------------------------------------------------

@query("repo_languages", lambda: D.std_ctes(extra=[("dl", f"SELECT repo_id, {_lang_case('file_path')} AS lang FROM docs")]) + f"""
SELECT repo_id, {_lang_set_sql()} AS languages FROM dl GROUP BY repo_id""")
def repo_languages(spark, sf):
    return an.repo_languages(I.documents(spark, sf)).select("repo_id", F.array_join("languages", ", ").alias("languages"))


@query("repo_frameworks", lambda: analysis_ctes() + f"SELECT repo_id, {_fw_set_sql()} AS frameworks FROM fw")
def repo_frameworks(spark, sf):
    return an.repo_frameworks(I.code_chunks(spark, sf)).select("repo_id", F.array_join("frameworks", ", ").alias("frameworks"))


@query("repo_frameworks_words", lambda: analysis_ctes([("fww", "SELECT repo_id, " + ", ".join(
    f"bool_or(regexp_matches(lower(content), {R(cf.whole_word(p))})) AS fw_{i}" for i, p in enumerate(K.FRAMEWORKS))
    + " FROM code_chunks GROUP BY repo_id")]) + f"SELECT repo_id, {_fw_set_sql()} AS frameworks FROM fww")
def repo_frameworks_words(spark, sf):
    """Frameworks whose pattern stands as a whole word."""
    return an.repo_frameworks(I.code_chunks(spark, sf), word_boundary=True).select(
        "repo_id", F.array_join("frameworks", ", ").alias("frameworks"))


# --- O36-O39 ---------------------------------------------------------------------------------

@query("key_functions", lambda: analysis_ctes() + """
SELECT repo_id, name, count(*) AS n FROM (SELECT repo_id, unnest(fns) AS name FROM fc) GROUP BY 1, 2""")
def key_functions(spark, sf):
    return an.key_functions(I.code_chunks(spark, sf))


@query("key_classes", lambda: analysis_ctes() + """
SELECT repo_id, name, count(*) AS n FROM (SELECT repo_id, unnest(cls) AS name FROM fc) GROUP BY 1, 2""")
def key_classes(spark, sf):
    return an.key_classes(I.code_chunks(spark, sf))


@query("repo_imports", lambda: analysis_ctes([("imps", _imports_sql())]) + "SELECT repo_id, import_name FROM imps")
def repo_imports(spark, sf):
    return an.repo_imports(I.code_chunks(spark, sf))


@query("api_endpoints", lambda: analysis_ctes([("eps", _endpoints_sql())]) + """
SELECT repo_id, method, path, count(*) AS n FROM eps GROUP BY 1, 2, 3""")
def api_endpoints(spark, sf):
    return an.api_endpoints(I.code_chunks(spark, sf))


# --- O40, O85, O86 ----------------------------------------------------------------------------

@query("repo_architecture", lambda: analysis_ctes([("arch", _arch_sql())]) + """
SELECT repo_id, architecture_type, n_classes, n_functions, has_main FROM arch""")
def repo_architecture(spark, sf):
    f = an.repo_facts(I.code_chunks(spark, sf))
    return f.select("repo_id", "architecture_type", "n_classes", "n_functions", "has_main")


@query("repo_analysis", lambda: analysis_ctes([
    ("dl", f"SELECT repo_id, {_lang_case('file_path')} AS lang FROM docs"),
    ("langs", f"SELECT repo_id, {_lang_set_sql()} AS languages FROM dl GROUP BY repo_id"),
    ("imps", _imports_sql()),
    ("arch", _arch_sql()),
]) + f"""
SELECT a.repo_id, coalesce(l.languages, 'Unknown') AS languages, {_fw_set_sql()} AS frameworks, a.architecture_type,
  coalesce(i.n_imports, 0) AS n_imports
FROM arch a JOIN fw ON fw.repo_id = a.repo_id LEFT JOIN langs l ON l.repo_id = a.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS n_imports FROM imps GROUP BY 1) i ON i.repo_id = a.repo_id""")
def repo_analysis(spark, sf):
    """Languages come from the documents' paths, the rest from the chunks."""
    chunks = I.code_chunks(spark, sf)
    f = an.repo_facts(chunks, I.documents(spark, sf))
    imps = an.repo_imports(chunks).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_imports"))
    return f.join(imps, "repo_id", "left").select(
        "repo_id", F.array_join("languages", ", ").alias("languages"), F.array_join("frameworks", ", ").alias("frameworks"),
        "architecture_type", F.coalesce("n_imports", F.lit(0)).cast("bigint").alias("n_imports"))


@query("analysis_summary", lambda: analysis_ctes([("imps", _imports_sql()), ("eps", _endpoints_sql())]) + """
SELECT x.repo_id, x.key_classes_count, x.key_functions_count, coalesce(e.n, 0) AS api_endpoints_count,
  coalesce(i.n, 0) AS imports_count, CAST(0 AS BIGINT) AS dependencies_count,
  w.document_classes_count, w.document_functions_count, w.document_endpoints_count
FROM (SELECT repo_id, CAST(sum(len(cls)) AS BIGINT) AS key_classes_count, CAST(sum(len(fns)) AS BIGINT) AS key_functions_count FROM fc GROUP BY 1) x
LEFT JOIN (SELECT repo_id, count(*) AS n FROM eps GROUP BY 1) e ON e.repo_id = x.repo_id
LEFT JOIN (SELECT repo_id, count(*) AS n FROM imps GROUP BY 1) i ON i.repo_id = x.repo_id
LEFT JOIN (SELECT repo_id, CAST(sum(len(list_distinct(regexp_extract_all(content, """ + R(K.CLASS_RE) + """, 1)))) AS BIGINT) AS document_classes_count,
  CAST(sum(len(list_distinct(regexp_extract_all(content, """ + R(K.FUNCTION_RE) + """, 1)))) AS BIGINT) AS document_functions_count,
  CAST(sum(len(regexp_extract_all(content, """ + R(K.ROUTE_RE) + """, 1)) + len(regexp_extract_all(content, """ + R(K.ROUTER_RE) + """, 1))
    + len(regexp_extract_all(content, """ + R(K.APP_METHOD_RE) + """, 1))) AS BIGINT) AS document_endpoints_count
  FROM code_docs GROUP BY 1) w ON w.repo_id = x.repo_id""")
def analysis_summary(spark, sf):
    return an.analysis_summary(I.code_chunks(spark, sf), I.code_documents(spark, sf))


# --- O41, O87 ----------------------------------------------------------------------------------

def _category_sql(p: str = "source_file") -> str:
    name = f"lower({D.base_name(p)})"
    e = D.ext(p)
    return f"""CASE WHEN coalesce({p}, '') = '' THEN 'other'
  WHEN contains({name}, 'test') OR contains({name}, 'spec') THEN 'tests'
  WHEN {name} IN {D.inlist(K.REQUIREMENT_FILES)} THEN 'requirements'
  WHEN {e} IN {D.inlist(K.DOCS_EXT)} OR contains({name}, 'readme') THEN 'docs'
  WHEN {e} IN {D.inlist(K.CONFIG_EXT)} THEN 'config'
  WHEN {e} IN {D.inlist(K.CODE_EXT)} THEN 'code' ELSE 'other' END"""


@query("chunk_categories", lambda: D.std_ctes() + f"SELECT chunk_id, {_category_sql()} AS category FROM chunks")
def chunk_categories(spark, sf):
    return an.categorize(I.chunks(spark, sf)).select("chunk_id", "category")


@query("category_counts", lambda: D.std_ctes() + f"""
SELECT repo_id, {_category_sql()} AS category, count(*) AS n_chunks FROM chunks GROUP BY 1, 2""")
def category_counts(spark, sf):
    return an.category_counts(I.chunks(spark, sf))
