"""Queries: text functions (O42-O48) over pages and the review/draft fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text
from ..operators.joins import salted_join
from ..operators import analysis as an
from ..sources import fixtures as fx
from . import duck as D
from . import inputs as I
from .registry import query

R = D.q
NL = "chr(10)"


def preprocess_sql(c: str) -> str:
    return (f"regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), "
            f"'[^\\p{{L}}\\p{{N}}_\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}-]', ' ', 'g')")


def clean_sql(c: str) -> str:
    t = D.strip(c)
    lines = f"string_split({t}, {NL})"
    fi = f"list_position(list_transform({lines}, lambda x: starts_with(x, '#') OR starts_with(x, '```')), true)"
    chatty = " OR ".join(f"starts_with({t}, {R(p)})" for p in K.PREAMBLE_PREFIXES)
    return f"CASE WHEN ({chatty}) AND {fi} > 0 THEN array_to_string({lines}[{fi}:], {NL}) ELSE {t} END"


def score_sql(c: str) -> str:
    digits = "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, {R(p)}, 1), '')" for p in K.SCORE_PATTERNS) + ")"
    tr = f"ltrim({digits}, '0')"
    return (f"CAST(CASE WHEN {digits} IS NULL THEN {K.DEFAULT_SCORE} WHEN {tr} = '' THEN 0 "
            f"WHEN length({tr}) > 3 THEN 100 ELSE least(CAST({tr} AS INTEGER), 100) END AS INTEGER)")


def has_placeholder_sql(c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, {R(p)})" for p in K.PLACEHOLDER_PHRASES) + ")"


def _repr_sql(x: str) -> str:
    esc = f"replace(replace(replace({x}, '\\', '\\\\'), chr(9), '\\t'), chr(13), '\\r')"
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


def report_sql(c: str) -> str:
    found = f"regexp_extract_all({c}, '\\{{\\{{(.*?)\\}}\\}}', 1)"
    shown = f"'[' || array_to_string(list_transform({found}[1:{K.PLACEHOLDER_REPORT_LIMIT}], lambda x: {_repr_sql('x')}), ', ') || ']'"
    first = f"CASE WHEN len({found}) > 0 THEN 'Found ' || CAST(len({found}) AS VARCHAR) || ' template placeholders: ' || {shown} END"
    items = [first] + [f"CASE WHEN contains({c}, {R(p)}) THEN {R(d)} END" for p, d in K.PLACEHOLDER_ISSUES]
    issues = "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"
    body = f"array_to_string(list_transform({issues}, lambda x: '- ' || x), {NL})"
    return (f"CASE WHEN len({issues}) > 0 THEN {R(K.PLACEHOLDER_REPORT_HEADER)} || {NL} || {body} "
            f"ELSE {R(K.PLACEHOLDER_REPORT_OK)} END")


def fill_sql(c: str, vals: dict[str, str]) -> str:
    out = c
    for ph, field in K.PLACEHOLDER_FILLS:
        pat = "(?i)" + ph.replace("{", "\\{").replace("}", "\\}")
        v = f"replace({vals[field]}, '\\', '\\\\')"
        out = f"regexp_replace({out}, {R(pat)}, {v}, 'g')"
    return out


# --- O42, O43 -----------------------------------------------------------------------

@query("preprocess_text", lambda: f"SELECT page_id, {preprocess_sql('html')} AS clean_text FROM pages")
def preprocess_text(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", text.preprocess("html").alias("clean_text"))


@query("safe_names", lambda: """SELECT page_id, substring(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), 1, 50) AS safe_name,
  substring(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), 1, 50) || '_comprehensive_docs.md' AS output_file FROM pages""")
def safe_names(spark, sf):
    p = fx.table(spark, sf, "pages")
    return p.select("page_id", text.safe_name("url").alias("safe_name"),
                    F.concat(text.safe_name("url"), F.lit("_comprehensive_docs.md")).alias("output_file"))


# --- O44-O47 ------------------------------------------------------------------------

@query("clean_responses", lambda: D.with_ctes(["fx_drafts"], []) + f"SELECT doc_id, {clean_sql('draft')} AS cleaned FROM fx_drafts")
def clean_responses(spark, sf):
    return fx.view(spark, sf, "fx_drafts").select("doc_id", text.clean_response("draft").alias("cleaned"))


@query("review_scores", lambda: D.with_ctes(["fx_reviews"], []) + f"SELECT doc_id, {score_sql('review')} AS score FROM fx_reviews")
def review_scores(spark, sf):
    return fx.view(spark, sf, "fx_reviews").select("doc_id", text.review_score("review").alias("score"))


@query("placeholder_flags", lambda: D.with_ctes(["fx_drafts"], []) + f"SELECT doc_id, {has_placeholder_sql('draft')} AS has_placeholder FROM fx_drafts")
def placeholder_flags(spark, sf):
    return fx.view(spark, sf, "fx_drafts").select("doc_id", text.has_placeholder("draft").alias("has_placeholder"))


@query("placeholder_issues", lambda: D.with_ctes(["fx_drafts"], []) + f"SELECT doc_id, {report_sql('draft')} AS report FROM fx_drafts")
def placeholder_issues(spark, sf):
    return fx.view(spark, sf, "fx_drafts").select("doc_id", text.placeholder_report("draft").alias("report"))


# --- O48 ----------------------------------------------------------------------------------

def draft_context_sql() -> str:
    """DuckDB: drafts joined to per-repo fill values (languages from the
    documents' paths, frameworks from the code chunks)."""
    from .q_analysis import _fw_flags_sql, _fw_set_sql, _lang_case, _lang_set_sql
    return D.std_ctes(code=True, extra=[
        ("fw", _fw_flags_sql()),
        ("dl", f"SELECT repo_id, {_lang_case('file_path')} AS lang FROM docs"),
        ("langs", f"SELECT repo_id, {_lang_set_sql()} AS languages FROM dl GROUP BY repo_id"),
        ("fws", f"SELECT repo_id, {_fw_set_sql()} AS frameworks FROM fw"),
        ("dctx", f"""SELECT d.doc_id, d.draft, d.repo AS repo_name, '/data/' || d.repo AS repo_source,
  coalesce(l.languages, 'Unknown') AS languages, coalesce(f.frameworks, 'Unknown') AS frameworks,
  replace(lower(d.repo), ' ', '-') AS project_dir
FROM fx_drafts d LEFT JOIN langs l ON l.repo_id = {D.repo_id("'/data/' || d.repo")}
LEFT JOIN fws f ON f.repo_id = {D.repo_id("'/data/' || d.repo")}"""),
    ]).replace("WITH fx_files AS", "WITH fx_drafts AS (" + fx.FX_DRAFTS.replace("{documents}", "documents").strip() + "),\nfx_files AS", 1)


def draft_context(spark, sf):
    """Spark: drafts with the per-repo fill values."""
    d = fx.view(spark, sf, "fx_drafts").withColumn("repo_source", F.concat(F.lit("/data/"), F.col("repo")))
    d = d.withColumn("repo_id", F.concat(F.lit("repo_"), F.substring(F.md5("repo_source"), 1, 12)))
    langs = an.repo_languages(I.documents(spark, sf))
    fws = an.repo_frameworks(I.code_chunks(spark, sf))
    unknown = F.array(F.lit("Unknown"))
    # drafts of one repository may be very many; each join has one row a repository
    d = salted_join(salted_join(d, langs, ["repo_id"], "left", "doc_id"), fws, ["repo_id"], "left", "doc_id")
    return d.select(
        "doc_id", "draft", "repo_id", F.col("repo").alias("repo_name"), "repo_source",
        F.array_join(F.coalesce("languages", unknown), ", ").alias("languages"),
        F.array_join(F.coalesce("frameworks", unknown), ", ").alias("frameworks"),
        F.regexp_replace(F.lower("repo"), " ", "-").alias("project_dir"))


FILL_FIELDS = ["repo_name", "languages", "frameworks", "repo_source", "project_dir"]


@query("fill_placeholders", lambda: draft_context_sql() + f"""
SELECT doc_id, {fill_sql('draft', {k: k for k in FILL_FIELDS})} AS filled FROM dctx""")
def fill_placeholders(spark, sf):
    d = draft_context(spark, sf)
    return d.select("doc_id", text.fill_placeholders("draft", {k: F.col(k) for k in FILL_FIELDS}).alias("filled"))
