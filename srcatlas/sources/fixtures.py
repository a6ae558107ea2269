"""Derived test views over the driver tables (FIXTURES.md §3).

Each statement is valid unchanged in Spark SQL and DuckDB. ``{documents}``,
``{pages}``, ``{embeddings}`` and ``{fx_files}`` are table slots: Spark fills
them with direct parquet references, the oracle with the registered
views.
Every view is a per-row projection of a driver table, so its size grows with
the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX_FILES = """
SELECT doc_id, source AS repo, concat('/data/', source) AS repo_source,
  concat(split_part('src,src/core,docs,tests,config,build,.git,a,a-b,vendor,lib', ',', CAST(doc_id % 11 AS INT) + 1), '/',
    CASE WHEN doc_id % 29 = 0 THEN concat(CAST(doc_id AS VARCHAR(20)), '/setup.py')
         WHEN doc_id % 31 = 0 THEN concat(CAST(doc_id AS VARCHAR(20)), '/package-lock.json')
         WHEN doc_id % 37 = 0 THEN concat('.hidden', CAST(doc_id AS VARCHAR(20)))
         ELSE concat(split_part('mod,test_mod,readme,util_spec,app', ',', CAST(doc_id % 5 AS INT) + 1), '_', CAST(doc_id AS VARCHAR(20)),
              CASE WHEN doc_id % 17 = 16 THEN ''
                   ELSE concat('.', split_part('py,js,ts,java,go,rs,md,txt,toml,yaml,json,png,cs,cpp,rb,xyz', ',', CAST(doc_id % 16 AS INT) + 1)) END) END) AS rel_path,
  n_chars AS size_bytes, text AS content
FROM {documents}
"""

FX_CODE = """
SELECT doc_id, source AS repo, concat(text, chr(10), 'import mod', CAST(doc_id % 7 AS VARCHAR(9)), ', os', chr(10),
  'from pkg', CAST(doc_id % 5 AS VARCHAR(9)), ' import thing', chr(10),
  'class C', CAST(doc_id % 13 AS VARCHAR(9)), '(Base):', chr(10),
  '    def f', CAST(doc_id % 11 AS VARCHAR(9)), '(self, a):', chr(10),
  CASE WHEN doc_id % 10 = 0 THEN concat('@app.route("/r', CAST(doc_id AS VARCHAR(20)), '")')
       WHEN doc_id % 10 = 1 THEN concat('@router.get("/i', CAST(doc_id AS VARCHAR(20)), '")') ELSE '' END, chr(10),
  CASE WHEN source IN ('src0', 'src3') THEN 'import flask' WHEN source IN ('src1', 'src4') THEN 'uses React'
       WHEN source = 'src2' THEN 'langchain with ollama' ELSE '' END) AS content
FROM {documents}
"""

FX_STORED_FILES = """
SELECT doc_id, repo, repo_source, rel_path, size_bytes,
  CASE WHEN repo IN ('src2', 'src7') AND doc_id % 3 = 0 THEN concat(content, ' v0') ELSE content END AS content
FROM {fx_files} WHERE repo <> 'src5'
"""

FX_SOURCES = """
SELECT page_id AS source_id, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN url WHEN 1 THEN concat('github.com/org/', CAST(page_id AS VARCHAR(20)), '.git')
  WHEN 2 THEN concat('www.', CAST(page_id AS VARCHAR(20)), '.com') WHEN 3 THEN concat('/data/src', CAST(page_id % 30 AS VARCHAR(20)))
  WHEN 4 THEN 'http://' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE concat(url, '.git') END AS source
FROM {pages}
"""

FX_REVIEWS = """
SELECT doc_id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN concat('SCORE: ', CAST(doc_id % 140 AS VARCHAR(9)))
  WHEN 1 THEN concat('**Overall Score: ', CAST(doc_id % 101 AS VARCHAR(9)), '/100**') WHEN 2 THEN concat('I give ', CAST(doc_id % 101 AS VARCHAR(9)), '/100')
  WHEN 3 THEN concat('about ', CAST(doc_id % 101 AS VARCHAR(9)), '% done') WHEN 4 THEN 'no number' ELSE concat('score:', CAST(doc_id % 50 AS VARCHAR(9)), ' 99/100') END AS review
FROM {documents}
"""

FX_DRAFTS = """
SELECT doc_id, source AS repo, concat(CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN concat('Here is the doc', chr(10)) WHEN 1 THEN concat('Based on it', chr(10), 'well', chr(10)) ELSE '' END,
  '# ', CASE WHEN doc_id % 3 = 0 THEN '{{Project Name}}' ELSE source END, chr(10),
  CASE WHEN doc_id % 5 = 0 THEN 'Describe the system' ELSE 'A system' END, chr(10),
  CASE WHEN doc_id % 7 = 0 THEN 'clone {{repository-URL}} {{x}}' ELSE 'clone it' END) AS draft
FROM {documents}
"""

FX_VECTORS_SPARK = """
SELECT vec_id, CASE CAST(vec_id % 25 AS INT)
  WHEN 0 THEN CAST(slice(embedding, 1, 63) AS ARRAY<FLOAT>) WHEN 1 THEN CAST(array() AS ARRAY<FLOAT>)
  WHEN 2 THEN concat(slice(embedding, 1, 63), array(float('nan'))) WHEN 3 THEN concat(slice(embedding, 1, 63), array(float('inf')))
  ELSE embedding END AS vector FROM {embeddings}
"""

FX_VECTORS_DUCKDB = """
SELECT vec_id, CASE CAST(vec_id % 25 AS INT)
  WHEN 0 THEN embedding[1:63] WHEN 1 THEN CAST([] AS FLOAT[])
  WHEN 2 THEN list_append(embedding[1:63], CAST('nan' AS FLOAT)) WHEN 3 THEN list_append(embedding[1:63], CAST('inf' AS FLOAT))
  ELSE embedding END AS vector FROM {embeddings}
"""

SPARK_VIEWS = {
    "fx_files": FX_FILES, "fx_code": FX_CODE, "fx_stored_files": FX_STORED_FILES,
    "fx_sources": FX_SOURCES, "fx_reviews": FX_REVIEWS, "fx_drafts": FX_DRAFTS,
    "fx_vectors": FX_VECTORS_SPARK,
}
DUCKDB_VIEWS = dict(SPARK_VIEWS, fx_vectors=FX_VECTORS_DUCKDB)
BASE_TABLES = ["documents", "pages", "embeddings", "events", "conversations", "labels", "benchmark"]


def _fill(sql: str, slots: dict[str, str]) -> str:
    for name, ref in slots.items():
        sql = sql.replace("{" + name + "}", ref)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A file of one row group is one task's work, so a table
    of fewer splits than cores is dealt out here, at the scan; a larger one is
    left alone. (The splits of a bare scan are known without any job.)"""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a lazy DataFrame over the parquet tables of ``sf_dir``."""
    text = SPARK_VIEWS[name] + (FX_FILES if "{fx_files}" in SPARK_VIEWS[name] else "")
    slots = {}
    for t in BASE_TABLES:
        if "{" + t + "}" in text:
            slots[t] = f"driver_{t}"
            table(spark, sf_dir, t).createOrReplaceTempView(slots[t])
    slots["fx_files"] = "(" + _fill(FX_FILES, slots) + ") AS fx_files_src"
    return spark.sql(_fill(SPARK_VIEWS[name], slots))


def duckdb_cte(*names: str) -> str:
    """``WITH`` clause defining the named fixture views for the oracle."""
    need = list(names)
    if "fx_stored_files" in need and "fx_files" not in need:
        need.insert(0, "fx_files")
    order = ["fx_files", "fx_code", "fx_stored_files", "fx_sources", "fx_reviews", "fx_drafts", "fx_vectors"]
    slots = {t: t for t in BASE_TABLES}
    slots["fx_files"] = "fx_files"
    parts = [f"{n} AS ({_fill(DUCKDB_VIEWS[n], slots).strip()})" for n in order if n in need]
    return "WITH " + ",\n".join(parts) + "\n"
