"""Per-repository documentation: samples, context, report, prompts,
rendering, review rounds and results.

Every step is a per-repository aggregate or a projection of one. Lists
that feed text are ranked with constant limits first (samples, first
classes/functions), so no repository ever collects more than a few dozen
rows, however large it is.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths, text
from . import analysis as an
from . import chunking

#: Parts in which a group's samples are ranked first.
SAMPLE_PARTS = 32
#: Size up to which a template is taken as configuration, by default.
MAX_TEMPLATE_BYTES = 1 << 20


# --- templates ------------------------------------------------------------------

def load_template(path_or_name: str, max_bytes: int | None = MAX_TEMPLATE_BYTES) -> str:
    """Template text: a packaged template by name or a file path. Templates
    are configuration, inlined as literals; one above ``max_bytes`` raises
    (None: no limit)."""
    if "/" not in path_or_name:
        t = resources.files("srcatlas.data").joinpath(path_or_name).read_text("utf-8")
    else:
        with open(path_or_name, encoding="utf-8") as f:
            t = f.read() if max_bytes is None else f.read(max_bytes + 1)
    if max_bytes is not None and len(t.encode("utf-8")) > max_bytes:
        raise ValueError(f"template larger than {max_bytes} bytes")
    return t


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Template with ``{slot}`` markers -> concat of literals and columns."""
    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{([a-z_]+)\}", template):
        parts.append(F.lit(template[pos:m.start()]))
        v = values.get(m.group(1))
        parts.append(F.coalesce(v, F.lit("")) if v is not None else F.lit(m.group(0)))
        pos = m.end()
    parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


# --- repository info and samples ----------------------------------------------------

def repo_info(repositories: DataFrame) -> DataFrame:
    """id, source and display name (last path part with '.git' removed)."""
    name = F.regexp_replace(paths.base_name(F.regexp_replace("source", r"/+$", "")), r"\.git", "")
    return repositories.select(F.col("id").alias("repo_id"), F.col("source").alias("repo_source"),
                               F.when(F.col("source").isNull(), F.col("id")).otherwise(name).alias("repo_name"))


def top_samples(chunks: DataFrame, limits: dict[str, int] = K.SAMPLE_LIMITS) -> DataFrame:
    """Longest chunks per (repository, category), ``limits[category]`` of
    each, ties in chunk-id order.

    Ranking sees sizes and ids only, in two steps: the best of each of
    ``SAMPLE_PARTS`` parts of a group, then the best of those, so a group that
    holds a third of all chunks is ranked by many tasks. The constant cap lets
    Spark cut every map task's rows before either shuffle. The texts of the
    chosen chunks are fetched at the end."""
    cap = max(limits.values())
    lim = F.create_map(*[x for kv in limits.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    group, order = ["repo_id", "category"], [F.desc("size"), F.asc("chunk_id"), F.asc("chunk_num")]
    light = an.categorize(chunks).select(*group, "size", "chunk_id", "chunk_num").withColumn(
        "_part", F.pmod(F.xxhash64("chunk_id", "chunk_num"), F.lit(SAMPLE_PARTS)))
    best = light.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_rank") <= cap)
    ranked = best.drop("_part", "_rank").withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(
        F.col("rank") <= cap)
    chosen = ranked.where(F.col("rank") <= F.element_at(lim, F.col("category")))
    return chunks.join(chosen.select("category", "chunk_id", "chunk_num", "rank"), ["chunk_id", "chunk_num"])


def first_items(chunks: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """repo_id -> the first classes and functions in chunk order (chunk id,
    then position), joined by ', '. One pass over the chunks: each chunk
    yields a (kind, names) row per kind, and one window per (repo, kind)
    with a constant cap keeps at most that many rows per map task."""
    from ..functions import codefacts as cf
    lim = limits or {"key_classes": K.REPORT_MAX_CLASSES, "key_functions": K.REPORT_MAX_FUNCTIONS}
    kinds = F.array(F.struct(F.lit("key_classes").alias("kind"), cf.classes("content").alias("names")),
                    F.struct(F.lit("key_functions").alias("kind"), cf.functions("content").alias("names")))
    per_kind = chunks.select("repo_id", "chunk_id", F.explode(kinds).alias("k"))
    ex = per_kind.select("repo_id", "chunk_id", F.col("k.kind").alias("kind"),
                         F.posexplode("k.names").alias("pos", "item"))
    w = Window.partitionBy("repo_id", "kind").orderBy("chunk_id", "pos")
    cap = max(lim.values())
    lim_map = F.create_map(*[x for kv in lim.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    top = ex.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= cap) \
        .where(F.col("rk") <= F.element_at(lim_map, F.col("kind")))
    got = top.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("kind", "rk", "item"))).alias("_l"))
    def of_kind(k: str) -> Column:
        # ≤ sum(limits) elements per repository: the lambdas here are cheap.
        return F.array_join(F.transform(F.filter("_l", lambda x: x["kind"] == F.lit(k)), lambda x: x["item"]), ", ").alias(k)

    return got.select("repo_id", *[of_kind(k) for k in lim])


def repo_context(repositories: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One context row per repository with chunks: names, counts, analysis.

    Three passes over the chunks (facts + config files in one aggregate,
    first names, and, in the report, samples) and one over the documents."""
    from ..functions import codefacts as cf
    info = repo_info(repositories)
    fw_labels = list(K.FRAMEWORKS.values())
    lang_labels = sorted(set(K.LANGUAGES.values()))
    lang = cf.language("file_path")
    dagg = documents.groupBy("repo_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_documents"),
        *[F.max((lang == F.lit(l)).cast("int")).alias(f"has_{i}") for i, l in enumerate(lang_labels)])
    dinfo = dagg.select("repo_id", "total_documents", an._sorted_set(lang_labels).alias("languages"))
    facts = an.chunk_facts(chunks).withColumn(
        "_cfg", F.when(cf.category("source_file") == "config", F.col("source_file"))).withColumn(
        "_test", F.when(cf.category("source_file") == "tests", F.col("source_file")))
    cagg = facts.groupBy("repo_id").agg(*an._facts_aggs(fw_labels),
                                        F.count_distinct("_cfg").cast("bigint").alias("n_config_files"),
                                        F.count_distinct("_test").cast("bigint").alias("n_test_files"))
    cinfo = an._facts_select(cagg, fw_labels, ["n_config_files", "n_test_files"])
    names = first_items(chunks)
    ctx = info.join(cinfo, "repo_id").join(dinfo, "repo_id", "left").join(names, "repo_id", "left")
    return ctx.select(
        "repo_id", "repo_name", "repo_source",
        F.coalesce("total_documents", F.lit(0)).cast("bigint").alias("total_documents"),
        F.col("n_chunks").cast("bigint").alias("total_chunks"),
        F.coalesce("languages", F.array(F.lit("Unknown"))).alias("languages"), "frameworks", "architecture_type",
        F.col("n_classes").alias("key_classes_count"), F.col("n_functions").alias("key_functions_count"),
        F.col("n_endpoints").alias("api_endpoints_count"),
        F.coalesce("n_config_files", F.lit(0)).cast("bigint").alias("n_config_files"),
        F.coalesce("n_test_files", F.lit(0)).cast("bigint").alias("n_test_files"),
        F.coalesce("key_classes", F.lit("")).alias("key_classes"),
        F.coalesce("key_functions", F.lit("")).alias("key_functions"),
        # declared by the original's context and never filled there
        *[F.array().cast("array<string>").alias(c) for c in K.UNFILLED_CONTEXT])


def _sample_lines(samples: DataFrame, n: int = K.REPORT_SAMPLES, chars: int = K.REPORT_SAMPLE_CHARS) -> DataFrame:
    """repo_id -> report lines of the first ``n`` samples of each category."""
    order = F.create_map(*[x for i, c in enumerate(K.CATEGORY_ORDER) for x in (F.lit(c), F.lit(i))])
    s = samples.where(F.col("rank") <= n)
    fname = F.when(F.coalesce(F.col("source_file"), F.lit("")) == "", F.lit("unknown")).otherwise(paths.base_name("source_file"))
    body = F.array(
        F.concat(F.lit("  "), F.col("rank").cast("string"), F.lit(". File: "), fname),
        F.concat(F.lit("     Content: "), F.substring("content", 1, chars), F.lit("...")),
        F.lit(""))
    lines = F.when(F.col("rank") == 1, F.concat(F.array(F.concat(F.upper("category"), F.lit(" EXAMPLES:"))), body)).otherwise(body)
    per = s.select("repo_id", F.struct(F.element_at(order, F.col("category")).alias("o"), F.col("rank").alias("r"), lines.alias("l")).alias("x"))
    return per.groupBy("repo_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"])).alias("sample_lines"))


def context_report(ctx: DataFrame, samples: DataFrame) -> DataFrame:
    """repo_id -> the plain-text analysis report fed to the writer."""
    shown = {
        "repo_name": F.col("repo_name"), "repo_source": F.col("repo_source"), "architecture_type": F.col("architecture_type"),
        "total_documents": F.col("total_documents").cast("string"), "total_chunks": F.col("total_chunks").cast("string"),
        "languages": F.array_join("languages", ", "), "frameworks": F.array_join("frameworks", ", "), "dependencies": F.lit(""),
        "key_classes": F.col("key_classes"), "key_functions": F.col("key_functions"),
        "api_endpoints": F.col("api_endpoints_count").cast("string"), "config_files": F.col("n_config_files").cast("string")}
    head = F.array(*[fill_template(line, shown) for line in K.REPORT_HEAD])
    lines = _sample_lines(samples)
    j = ctx.join(lines, "repo_id", "left")
    all_lines = F.concat(head, F.coalesce(F.col("sample_lines"), F.array().cast("array<string>")))
    return j.select("repo_id", F.array_join(all_lines, "\n").alias("report"))


# --- prompts and rendering -------------------------------------------------------------

def _context_values(ctx: DataFrame) -> dict[str, Column]:
    return {
        "repo_name": F.col("repo_name"), "repo_source": F.col("repo_source"),
        "languages": F.array_join("languages", ", "), "frameworks": F.array_join("frameworks", ", "),
        "total_chunks": F.col("total_chunks").cast("string"),
        "total_documents": F.col("total_documents").cast("string"),
        "context": F.col("report"),
        "project_dir": F.regexp_replace(F.lower("repo_name"), " ", "-"),
    }


def writer_prompts(ctx_report: DataFrame, template: str | None = None) -> DataFrame:
    t = template if template is not None else load_template("writer_template.md")
    return ctx_report.select("repo_id", fill_template(t, _context_values(ctx_report)).alias("prompt"))


def reviewer_prompts(drafts: DataFrame, template: str | None = None) -> DataFrame:
    t = template if template is not None else load_template("reviewer_template.md")
    vals = dict(_context_values(drafts), draft=F.col("draft"))
    return drafts.select("repo_id", fill_template(t, vals).alias("prompt"))


def revision_prompts(drafts: DataFrame, template: str | None = None, key: str = "repo_id") -> DataFrame:
    """Prompt to revise ``draft`` given its ``review`` and the context report."""
    t = template if template is not None else load_template("revision_template.md")
    vals = dict(_context_values(drafts), previous=F.col("draft"), review=F.col("review"))
    return drafts.select(key, fill_template(t, vals).alias("prompt"))


def render_doc(ctx: DataFrame) -> Column:
    """Deterministic document from the context (the default writer)."""
    langs = F.array_join("languages", ", ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("repo_name")),
        F.lit(""),
        F.lit("## Overview"),
        F.concat(F.lit("A "), langs, F.lit(" project ("), F.col("architecture_type"), F.lit(").")),
        F.concat(F.lit("- Languages: "), langs),
        F.concat(F.lit("- Frameworks: "), F.array_join("frameworks", ", ")),
        F.concat(F.lit("- Size: "), F.col("total_chunks").cast("string"), F.lit(" chunks in "),
                 F.col("total_documents").cast("string"), F.lit(" files")),
        F.lit(""),
        F.lit("## Getting started"),
        F.lit("```bash"),
        F.concat(F.lit("git clone "), F.coalesce(F.col("repo_source"), F.lit(""))),
        F.concat(F.lit("cd "), F.regexp_replace(F.lower("repo_name"), " ", "-")),
        F.lit("```"),
    )


def render_docs(ctx: DataFrame) -> DataFrame:
    return ctx.select("repo_id", render_doc(ctx).alias("body"))


def output_name(name: str, repo_id: str) -> Column:
    """File name of a repository's document: its name made safe, which cuts
    long ones, and its id, so that no two repositories share one."""
    return F.concat(text.safe_name(name), F.lit("_"), F.col(repo_id), F.lit("_comprehensive_docs.md"))


def doc_metadata(ctx: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """repo_id, output file name and the metadata JSON of the generated document."""
    df = ctx if scores is None else ctx.join(scores.select("repo_id", "final_score"), "repo_id", "left")
    score = F.coalesce(F.col("final_score"), F.lit(K.DEFAULT_SCORE)) if scores is not None else F.lit(K.DEFAULT_SCORE)
    meta = F.struct(
        F.struct(F.col("total_chunks").alias("total_chunks_analyzed"), F.col("total_documents").alias("total_documents"),
                 score.cast("int").alias("final_quality_score"), F.col("architecture_type").alias("architecture_type")
                 ).alias("generation_info"),
        F.struct(F.col("repo_id").alias("id"), F.col("repo_name").alias("name"), F.col("repo_source").alias("source"),
                 F.col("languages").alias("languages"), F.col("frameworks").alias("frameworks")).alias("repository"),
        F.struct(F.col("key_classes_count"), F.col("key_functions_count"), F.col("api_endpoints_count"),
                 F.lit(0).cast("bigint").alias("dependencies_count")).alias("analysis_summary"))
    return df.select("repo_id", output_name("repo_name", "repo_id").alias("file_name"),
                     F.to_json(meta).alias("metadata_json"))


def write_docs(docs: DataFrame, path: str) -> None:
    """Document sink: of each row of ``docs(file_name, body, metadata_json)``
    the document and, beside it, its metadata, as files in ``path``."""
    from ..sources.export import write_files
    meta = F.regexp_replace("file_name", r"\.md$", ".metadata.json")
    files = docs.select(F.explode(F.array(
        F.struct(F.col("file_name"), F.col("body").alias("content")),
        F.struct(meta.alias("file_name"), F.col("metadata_json").alias("content")))).alias("f")).select("f.file_name", "f.content")
    write_files(files, path)


def document_repositories(repositories: DataFrame, documents: DataFrame, chunks: DataFrame, path: str,
                          scores: DataFrame | None = None) -> DataFrame:
    """Write one document and metadata file a repository to ``path`` with the
    deterministic writer. Returns the results, a row for each repository."""
    ctx = repo_context(repositories, documents, chunks)
    write_docs(render_docs(ctx).join(doc_metadata(ctx, scores), "repo_id"), path)
    return generation_results(repositories, chunks, scores)


# --- review rounds -------------------------------------------------------------------------

def rubric_score(draft: Column) -> Column:
    """A deterministic rubric that penalises leftover placeholders and
    instruction phrases and rewards a heading."""
    n_ph = F.size(text.placeholders(draft))
    instr = F.lit(0)
    for phrase, _ in K.PLACEHOLDER_ISSUES[1:3]:
        instr = instr + draft.contains(phrase).cast("int")
    heading = draft.rlike("(^|\n)#").cast("int")
    return F.greatest(F.lit(0), F.lit(100) - n_ph * 15 - instr * 10 - (1 - heading) * 20)


def rubric_review(draft: Column) -> Column:
    """Default reviewer: the rubric's score and what is left to fill in."""
    return F.concat(F.lit("SCORE: "), rubric_score(draft).cast("string"), F.lit("\n"), text.placeholder_report(draft))


def revise(drafts: DataFrame, values: dict[str, Column] | None = None, target: int = K.TARGET_SCORE,
           rounds: int = K.MAX_ROUNDS, first_review: str | None = None,
           checkpoint_every: int | None = None) -> DataFrame:
    """Score-gated rounds, unrolled: review; stop at ``target``; otherwise
    rewrite (clean preamble, fill placeholders) unless it was the last round.

    ``drafts`` has ``draft`` plus the context columns named in ``values``;
    ``first_review`` optionally names a column holding round one's review.
    With ``checkpoint_every=k`` the plan is cut every k rounds by a
    checkpoint in the folder named by ``spark.checkpoint.dir`` (for many
    rounds; the default three need none). Adds ``final_draft``,
    ``final_score``, ``rounds``.
    """
    df = drafts.withColumn("_d", F.col("draft")).withColumn("_done", F.lit(False)) \
        .withColumn("_score", F.lit(K.DEFAULT_SCORE)).withColumn("_rounds", F.lit(0))
    for i in range(1, rounds + 1):
        # the rubric's own score needs no review text to be read out of
        score = text.review_score(F.col(first_review)) if (i == 1 and first_review) else rubric_score(F.col("_d"))
        active = ~F.col("_done")
        df = df.withColumn("_score", F.when(active, score).otherwise(F.col("_score"))) \
            .withColumn("_rounds", F.when(active, F.lit(i)).otherwise(F.col("_rounds")))
        reached = F.col("_score") >= target
        if i < rounds:
            rewrite = text.fill_placeholders(text.clean_response(F.col("_d")), values or {})
            df = df.withColumn("_d", F.when(active & ~reached, rewrite).otherwise(F.col("_d")))
        df = df.withColumn("_done", F.col("_done") | reached)
        if checkpoint_every and i % checkpoint_every == 0 and i < rounds:
            from ..session import ensure_checkpoint_dir
            ensure_checkpoint_dir(df.sparkSession)
            df = df.checkpoint(eager=True)
    return df.withColumnRenamed("_d", "final_draft").withColumnRenamed("_score", "final_score") \
        .withColumnRenamed("_rounds", "rounds").drop("_done")


def repo_scores(revised: DataFrame) -> DataFrame:
    """(repo_id, final_score): the whole part of the mean final score of a
    repository's revised drafts."""
    return revised.groupBy("repo_id").agg(F.floor(F.avg("final_score")).cast("int").alias("final_score"))


# --- results ---------------------------------------------------------------------------------

def chunk_counts(documents: DataFrame) -> DataFrame:
    """(repo_id, n): how many windows the fixed chunker cuts of a repository's
    documents, from their lengths; nothing is cut."""
    return documents.groupBy("repo_id").agg(F.sum(chunking.fixed_count(F.col("content"))).cast("bigint").alias("n"))


def generation_results(repositories: DataFrame, chunks: DataFrame | None, scores: DataFrame | None = None,
                       counts: DataFrame | None = None) -> DataFrame:
    """One result per repository; repositories without chunks fail with
    'No data found'. ``counts(repo_id, n)`` may stand for ``chunks``."""
    info = repo_info(repositories)
    n = counts if counts is not None else chunks.groupBy("repo_id").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    df = info.join(n, "repo_id", "left")
    if scores is not None:
        df = df.join(scores.select("repo_id", "final_score"), "repo_id", "left")
    ok = F.coalesce(F.col("n"), F.lit(0)) > 0
    score = F.coalesce(F.col("final_score"), F.lit(K.DEFAULT_SCORE)) if scores is not None else F.lit(K.DEFAULT_SCORE)
    return df.select(
        "repo_id", "repo_name", ok.alias("success"),
        F.when(ok, output_name("repo_name", "repo_id")).alias("output_file"),
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("No data found")).alias("error"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("total_chunks_analyzed"),
        F.when(ok, score.cast("int")).otherwise(F.lit(0)).alias("final_score"))


def generation_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if("success").cast("bigint").alias("successful"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.round(F.avg(F.when(F.col("success"), F.col("final_score"))), 2).alias("avg_score"),
        F.sum("total_chunks_analyzed").cast("bigint").alias("total_chunks"))


def run_outcomes(results: DataFrame) -> DataFrame:
    status = F.when(F.col("success"), F.lit("ok")).otherwise(F.lit("failed"))
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
