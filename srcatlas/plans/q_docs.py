"""Queries: samples, context, report, prompts, rendering, rounds, results
(O62-O65, O88, O89, O95, O96, O112, O116, O117).

The corpus for these is today's documents plus the code documents of the
same repositories (both keyed by ``/data/<source>``).
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths
from ..operators.joins import salted_join
from ..operators import chunking, docs as dc
from ..sources import fixtures as fx
from . import duck as D
from . import inputs as I
from .q_analysis import _arch_sql, _category_sql, _fw_flags_sql, _fw_set_sql, _functions_sql, _lang_case, _lang_set_sql
from .q_catalog import sources
from .q_text import draft_context, draft_context_sql, fill_sql, clean_sql, score_sql
from .registry import query

R = D.q
NL = "chr(10)"


# --- Spark inputs -------------------------------------------------------------------

def corpus(spark, sf):
    docs = I.documents(spark, sf).unionByName(I.code_documents(spark, sf))
    chunks = chunking.chunk_fixed(docs)
    # Only id and source of each repository are needed here (no digest pass).
    repos = docs.select(F.col("repo_id").alias("id"), F.col("repo_source").alias("source")).distinct()
    return repos, docs, chunks


def context(spark, sf):
    repos, docs, chunks = corpus(spark, sf)
    return dc.repo_context(repos, docs, chunks), chunks


def report(spark, sf):
    ctx, chunks = context(spark, sf)
    return ctx.join(dc.context_report(ctx, dc.top_samples(chunks)), "repo_id")


def _str_ctx(ctx):
    return ctx.select("repo_id", "repo_name", "repo_source", "total_documents", "total_chunks",
                      F.array_join("languages", ", ").alias("languages"), F.array_join("frameworks", ", ").alias("frameworks"),
                      "architecture_type", "key_classes", "key_functions", "api_endpoints_count", "n_config_files", "n_test_files")


# --- DuckDB CTEs ----------------------------------------------------------------------

def _limit_case() -> str:
    return "CASE category " + " ".join(f"WHEN {R(c)} THEN {n}" for c, n in K.SAMPLE_LIMITS.items()) + " END"


def _order_case() -> str:
    return "CASE category " + " ".join(f"WHEN {R(c)} THEN {i}" for i, c in enumerate(K.CATEGORY_ORDER)) + " END"


def _first_sql(col: str, n: int, out: str) -> str:
    return f"""SELECT repo_id, string_agg(item, ', ' ORDER BY chunk_id, pos) AS {out} FROM (
  SELECT repo_id, chunk_id, item, pos, row_number() OVER (PARTITION BY repo_id ORDER BY chunk_id, pos) AS rk FROM (
    SELECT repo_id, chunk_id, unnest({col}) AS item, unnest(generate_series(1, len({col}))) AS pos FROM fc))
WHERE rk <= {n} GROUP BY repo_id"""


def docs_ctes(extra=None) -> str:
    arch = _arch_sql().replace("code_chunks", "cchunks")
    ctes = [
        ("cdocs", "SELECT * FROM docs UNION ALL SELECT * FROM code_docs"),
        ("cchunks", "SELECT * FROM chunks UNION ALL SELECT * FROM code_chunks"),
        ("fw", _fw_flags_sql("cchunks")),
        ("fc", _functions_sql("cchunks")),
        ("arch", arch),
        ("dl", f"SELECT repo_id, {_lang_case('file_path')} AS lang FROM cdocs"),
        ("langs", f"SELECT repo_id, {_lang_set_sql()} AS languages FROM dl GROUP BY repo_id"),
        ("kc", _first_sql("cls", K.REPORT_MAX_CLASSES, "key_classes")),
        ("kf", _first_sql("fns", K.REPORT_MAX_FUNCTIONS, "key_functions")),
        ("eps", "SELECT repo_id, sum(len(regexp_extract_all(content, " + R(K.ROUTE_RE) + ", 1)) + len(regexp_extract_all(content, "
                + R(K.ROUTER_RE) + ", 1)) + len(regexp_extract_all(content, " + R(K.APP_METHOD_RE) + ", 1))) AS n FROM cchunks GROUP BY 1"),
        ("cat", f"SELECT *, {_category_sql()} AS category FROM cchunks"),
        ("cfg", "SELECT repo_id, count(DISTINCT source_file) AS n FROM cat WHERE category = 'config' GROUP BY 1"),
        ("tst", "SELECT repo_id, count(DISTINCT source_file) AS n FROM cat WHERE category = 'tests' GROUP BY 1"),
        ("ctx", f"""SELECT i.repo_id, regexp_replace(regexp_extract(regexp_replace(i.repo_source, '/+$', ''), '([^/]*)$', 1), '\\.git', '', 'g') AS repo_name,
  i.repo_source, i.total_documents, x.total_chunks, coalesce(l.languages, 'Unknown') AS languages, {_fw_set_sql()} AS frameworks,
  a.architecture_type, a.n_classes AS key_classes_count, a.n_functions AS key_functions_count,
  CAST(coalesce(e.n, 0) AS BIGINT) AS api_endpoints_count, CAST(coalesce(g.n, 0) AS BIGINT) AS n_config_files,
  CAST(coalesce(u.n, 0) AS BIGINT) AS n_test_files,
  coalesce(kc.key_classes, '') AS key_classes, coalesce(kf.key_functions, '') AS key_functions
FROM (SELECT repo_id, any_value(repo_source) AS repo_source, count(*) AS total_documents FROM cdocs GROUP BY 1) i
JOIN (SELECT repo_id, count(*) AS total_chunks FROM cchunks GROUP BY 1) x ON x.repo_id = i.repo_id
JOIN arch a ON a.repo_id = i.repo_id JOIN fw ON fw.repo_id = i.repo_id
LEFT JOIN langs l ON l.repo_id = i.repo_id LEFT JOIN eps e ON e.repo_id = i.repo_id LEFT JOIN cfg g ON g.repo_id = i.repo_id
LEFT JOIN tst u ON u.repo_id = i.repo_id LEFT JOIN kc ON kc.repo_id = i.repo_id LEFT JOIN kf ON kf.repo_id = i.repo_id"""),
        ("samp", f"""SELECT * FROM (SELECT repo_id, category, chunk_id, size, content, source_file,
  row_number() OVER (PARTITION BY repo_id, category ORDER BY size DESC, chunk_id) AS rank FROM cat)
WHERE rank <= {_limit_case()}"""),
        ("slines", f"""SELECT repo_id, string_agg(block, {NL} ORDER BY o, rank) AS sample_text FROM (
  SELECT repo_id, rank, {_order_case()} AS o,
    CASE WHEN rank = 1 THEN upper(category) || ' EXAMPLES:' || {NL} ELSE '' END
    || '  ' || CAST(rank AS VARCHAR) || '. File: ' || CASE WHEN coalesce(source_file, '') = '' THEN 'unknown' ELSE {D.base_name('source_file')} END
    || {NL} || '     Content: ' || substring(content, 1, {K.REPORT_SAMPLE_CHARS}) || '...' || {NL} AS block
  FROM samp WHERE rank <= {K.REPORT_SAMPLES}) GROUP BY repo_id"""),
        ("rep", f"""SELECT c.*, array_to_string([
  'REPOSITORY INFORMATION:', '- Name: ' || c.repo_name, '- Source: ' || c.repo_source,
  '- Architecture Type: ' || c.architecture_type, '- Total Files Analyzed: ' || CAST(c.total_documents AS VARCHAR),
  '- Total Code Chunks: ' || CAST(c.total_chunks AS VARCHAR), '', 'TECHNOLOGY STACK:', '- Languages: ' || c.languages,
  '- Frameworks: ' || c.frameworks, '- Key Dependencies: ', '', 'CODE STRUCTURE ANALYSIS:',
  '- Key Classes: ' || c.key_classes, '- Key Functions: ' || c.key_functions,
  '- API Endpoints: ' || CAST(c.api_endpoints_count AS VARCHAR) || ' found',
  '- Configuration Files: ' || CAST(c.n_config_files AS VARCHAR) || ' found', ''], {NL})
  || CASE WHEN s.sample_text IS NULL THEN '' ELSE {NL} || s.sample_text END AS report
FROM ctx c LEFT JOIN slines s ON s.repo_id = c.repo_id"""),
    ]
    return D.std_ctes(code=True, extra=ctes + (extra or []))


def _template_sql(template: str, vals: dict[str, str]) -> str:
    parts, pos = [], 0
    for m in re.finditer(r"\{([a-z_]+)\}", template):
        parts.append(R(template[pos:m.start()]))
        v = vals.get(m.group(1))
        parts.append(f"coalesce({v}, '')" if v else R(m.group(0)))
        pos = m.end()
    parts.append(R(template[pos:]))
    return " || ".join(parts)


# --- O95, O96, O62, O63 ------------------------------------------------------------------

@query("top_samples", lambda: docs_ctes() + "SELECT repo_id, category, CAST(rank AS BIGINT) AS rank, chunk_id, size FROM samp")
def top_samples(spark, sf):
    _, _, chunks = corpus(spark, sf)
    s = dc.top_samples(chunks)
    return s.select("repo_id", "category", F.col("rank").cast("bigint").alias("rank"), "chunk_id",
                    F.col("size").cast("bigint").alias("size"))


@query("repo_context", lambda: docs_ctes() + """
SELECT repo_id, repo_name, repo_source, total_documents, total_chunks, languages, frameworks, architecture_type,
  key_classes, key_functions, api_endpoints_count, n_config_files, n_test_files FROM ctx""")
def repo_context(spark, sf):
    ctx, _ = context(spark, sf)
    return _str_ctx(ctx)


@query("context_report", lambda: docs_ctes() + "SELECT repo_id, report FROM rep")
def context_report(spark, sf):
    return report(spark, sf).select("repo_id", "report")


# --- O64, O65, O112 -----------------------------------------------------------------------

def _sql_vals():
    return {"repo_name": "repo_name", "repo_source": "repo_source", "languages": "languages", "frameworks": "frameworks",
            "total_chunks": "CAST(total_chunks AS VARCHAR)", "total_documents": "CAST(total_documents AS VARCHAR)",
            "context": "report", "project_dir": "replace(lower(repo_name), ' ', '-')"}


@query("writer_prompts", lambda: docs_ctes() + f"""
SELECT repo_id, {_template_sql(dc.load_template('writer_template.md'), _sql_vals())} AS prompt FROM rep""")
def writer_prompts(spark, sf):
    return dc.writer_prompts(report(spark, sf))


@query("reviewer_prompts", lambda: docs_ctes() + f"""
SELECT repo_id, {_template_sql(dc.load_template('reviewer_template.md'), dict(_sql_vals(), draft=_render_sql()))} AS prompt FROM rep""")
def reviewer_prompts(spark, sf):
    r = report(spark, sf)
    return dc.reviewer_prompts(r.withColumn("draft", dc.render_doc(r)))


def _render_sql() -> str:
    return f"""concat_ws({NL}, '# ' || repo_name, '', '## Overview',
  'A ' || languages || ' project (' || architecture_type || ').', '- Languages: ' || languages,
  '- Frameworks: ' || frameworks, '- Size: ' || CAST(total_chunks AS VARCHAR) || ' chunks in ' || CAST(total_documents AS VARCHAR) || ' files',
  '', '## Getting started', '```bash', 'git clone ' || coalesce(repo_source, ''), 'cd ' || replace(lower(repo_name), ' ', '-'), '```')"""


@query("render_docs", lambda: docs_ctes() + f"SELECT repo_id, {_render_sql()} AS body FROM ctx")
def render_docs(spark, sf):
    ctx, _ = context(spark, sf)
    return dc.render_docs(ctx)


def _list_sql(c: str) -> str:
    return f"string_split({c}, ', ')"


@query("doc_metadata_json", lambda: docs_ctes() + f"""
SELECT ctx.repo_id, substring(regexp_replace(repo_name, '[<>:"/\\\\|?*]', '_', 'g'), 1, 50) || '_' || ctx.repo_id || '_comprehensive_docs.md' AS file_name,
  CAST(json_object(
    'generation_info', json_object('total_chunks_analyzed', total_chunks, 'total_documents', total_documents,
                                   'final_quality_score', coalesce(sc.final_score, {K.DEFAULT_SCORE}), 'architecture_type', architecture_type),
    'repository', json_object('id', ctx.repo_id, 'name', repo_name, 'source', repo_source,
                              'languages', {_list_sql('languages')}, 'frameworks', {_list_sql('frameworks')}),
    'analysis_summary', json_object('key_classes_count', key_classes_count, 'key_functions_count', key_functions_count,
                                    'api_endpoints_count', api_endpoints_count, 'dependencies_count', 0)) AS VARCHAR) AS metadata_json
FROM ctx LEFT JOIN ({_scores_sql()}) sc ON sc.repo_id = ctx.repo_id""")
def doc_metadata_json(spark, sf):
    ctx, _ = context(spark, sf)
    return dc.doc_metadata(ctx, dc.repo_scores(revised_drafts(spark, sf)))


# --- O116 -----------------------------------------------------------------------------------

def _rubric_sql(d: str) -> str:
    n_ph = f"len(regexp_extract_all({d}, '\\{{\\{{(.*?)\\}}\\}}', 1))"
    instr = " + ".join(f"CAST(contains({d}, {R(p)}) AS INTEGER)" for p, _ in K.PLACEHOLDER_ISSUES[1:3])
    heading = f"CAST(len(list_filter(string_split({d}, {NL}), lambda x: starts_with(x, '#'))) > 0 AS INTEGER)"
    return f"CAST(greatest(0, 100 - {n_ph} * 15 - ({instr}) * 10 - (1 - {heading}) * 20) AS INTEGER)"


def _rounds_sql() -> str:
    vals = {k: k for k in ["repo_name", "languages", "frameworks", "repo_source", "project_dir"]}

    def rewrite(d):
        return fill_sql(clean_sql(d), vals)
    return draft_context_sql().replace("WITH fx_drafts AS", "WITH fx_reviews AS (" + fx.FX_REVIEWS.replace("{documents}", "documents").strip() + "),\nfx_drafts AS", 1).rstrip("\n") + f""",
r1 AS (SELECT x.*, {score_sql('v.review')} AS s1 FROM dctx x JOIN fx_reviews v ON v.doc_id = x.doc_id),
r2 AS (SELECT *, CASE WHEN s1 >= {K.TARGET_SCORE} THEN draft ELSE {rewrite('draft')} END AS d2 FROM r1),
r3 AS (SELECT *, {_rubric_sql('d2')} AS s2 FROM r2),
r4 AS (SELECT *, CASE WHEN s1 >= {K.TARGET_SCORE} OR s2 >= {K.TARGET_SCORE} THEN d2 ELSE {rewrite('d2')} END AS d3 FROM r3),
r5 AS (SELECT *, {_rubric_sql('d3')} AS s3 FROM r4)
"""


@query("revision_rounds", lambda: _rounds_sql() + f"""
SELECT doc_id,
  CAST(CASE WHEN s1 >= {K.TARGET_SCORE} THEN 1 WHEN s2 >= {K.TARGET_SCORE} THEN 2 ELSE 3 END AS INTEGER) AS rounds,
  CAST(CASE WHEN s1 >= {K.TARGET_SCORE} THEN s1 WHEN s2 >= {K.TARGET_SCORE} THEN s2 ELSE s3 END AS INTEGER) AS final_score,
  md5(d3) AS final_draft_md5
FROM r5""")
def revision_rounds(spark, sf):
    out = revised_drafts(spark, sf)
    return out.select("doc_id", F.col("rounds").cast("int").alias("rounds"), F.col("final_score").cast("int").alias("final_score"),
                      F.md5("final_draft").alias("final_draft_md5"))


def _scores_sql() -> str:
    """Final score of each repository: the mean of its drafts' after the rounds."""
    score = f"CASE WHEN s1 >= {K.TARGET_SCORE} THEN s1 WHEN s2 >= {K.TARGET_SCORE} THEN s2 ELSE s3 END"
    return f"""SELECT {D.repo_id('repo_source')} AS repo_id, CAST(floor(avg(final)) AS INTEGER) AS final_score
FROM ({_rounds_sql()} SELECT repo_source, {score} AS final FROM r5) GROUP BY 1"""


def revised_drafts(spark, sf):
    """Round one's review is the fixture review; later rounds use the
    default rubric reviewer and the default (clean + fill) writer."""
    d = draft_context(spark, sf).join(fx.view(spark, sf, "fx_reviews"), "doc_id")
    vals = {k: F.col(k) for k in ["repo_name", "languages", "frameworks", "repo_source", "project_dir"]}
    return dc.revise(d, vals, first_review="review")


# --- O117, O88, O89 -----------------------------------------------------------------------------

def _results_sql() -> str:
    from .q_catalog import _classified_sql
    from ..sources import fixtures as fx
    head = docs_ctes([
        ("classified", _classified_sql()),
        ("srcs", "SELECT DISTINCT repo_source AS source FROM classified WHERE kind <> 'rejected'"),
        ("res", f"""SELECT {D.repo_id('s.source')} AS repo_id,
  regexp_replace(regexp_extract(regexp_replace(s.source, '/+$', ''), '([^/]*)$', 1), '\\.git', '', 'g') AS repo_name,
  coalesce(n.n, 0) > 0 AS success, CAST(coalesce(n.n, 0) AS BIGINT) AS total_chunks_analyzed,
  CAST(CASE WHEN coalesce(n.n, 0) > 0 THEN coalesce(sc.final_score, {K.DEFAULT_SCORE}) ELSE 0 END AS INTEGER) AS final_score
FROM srcs s LEFT JOIN ({_scores_sql()}) sc ON sc.repo_id = {D.repo_id('s.source')} LEFT JOIN (SELECT repo_id, count(*) AS n FROM cchunks GROUP BY 1) n ON n.repo_id = {D.repo_id('s.source')}"""),
    ])
    return head.replace("WITH fx_files AS", "WITH fx_sources AS (" + fx.FX_SOURCES.replace("{pages}", "pages").strip() + "),\nfx_files AS", 1)


def results(spark, sf, scored=True):
    docs = I.documents(spark, sf).unionByName(I.code_documents(spark, sf))
    repos = sources(spark, sf).select(paths.repo_id("source").alias("id"), "source").distinct()
    return dc.generation_results(repos, None, dc.repo_scores(revised_drafts(spark, sf)) if scored else None, dc.chunk_counts(docs))


@query("generation_results", lambda: _results_sql() + f"""
SELECT repo_id, repo_name, success,
  CASE WHEN success THEN substring(regexp_replace(repo_name, '[<>:"/\\\\|?*]', '_', 'g'), 1, 50) || '_' || repo_id || '_comprehensive_docs.md' END AS output_file,
  CASE WHEN success THEN NULL ELSE 'No data found' END AS error, total_chunks_analyzed,
  final_score FROM res""")
def generation_results(spark, sf):
    return results(spark, sf)


@query("generation_summary", lambda: _results_sql() + f"""
SELECT CAST(count_if(success) AS BIGINT) AS successful, count(*) AS total,
  round(avg(CASE WHEN success THEN final_score END), 2) AS avg_score, CAST(sum(total_chunks_analyzed) AS BIGINT) AS total_chunks
FROM res""")
def generation_summary(spark, sf):
    return dc.generation_summary(results(spark, sf))


@query("run_outcomes", lambda: _results_sql() + """
SELECT CASE WHEN success THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM res GROUP BY 1""")
def run_outcomes(spark, sf):
    return dc.run_outcomes(results(spark, sf, scored=False))


@query("revision_prompts", lambda: docs_ctes([
    ("rv", "SELECT doc_id, repo AS draft_repo, draft FROM (" + fx.FX_DRAFTS.replace("{documents}", "documents") + ")"),
    ("rw", "SELECT doc_id, review FROM (" + fx.FX_REVIEWS.replace("{documents}", "documents") + ")"),
]) + f"""
SELECT d.doc_id, {_template_sql(dc.load_template('revision_template.md'), dict(_sql_vals(), previous='d.draft', review='w.review'))} AS prompt
FROM rv d JOIN rw w ON w.doc_id = d.doc_id JOIN rep ON rep.repo_id = {D.repo_id("'/data/' || d.draft_repo")}""")
def revision_prompts(spark, sf):
    """Each draft with its review and its repository's analysis report."""
    from ..functions import paths
    drafts = fx.view(spark, sf, "fx_drafts").join(fx.view(spark, sf, "fx_reviews"), "doc_id")
    drafts = drafts.withColumn("repo_id", paths.repo_id(F.concat(F.lit("/data/"), F.col("repo")))).drop("repo")
    d = salted_join(drafts, report(spark, sf), ["repo_id"], "inner", "doc_id", wide=True)
    return dc.revision_prompts(d, key="doc_id")
