"""Queries: vectors (O31, O49, O50, O74, O90, O111, O115)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vf
from ..operators import vectors as vec
from ..sources import fixtures as fx
from . import duck as D
from . import inputs as I
from .registry import query

DIM = 64  # dimension of the driver's embeddings table (a parameter; the default model has 768)


def _status_sql(v: str = "vector", dim: int = DIM) -> str:
    return (f"CASE WHEN {v} IS NULL THEN 'null' WHEN len({v}) = 0 THEN 'empty' "
            f"WHEN list_bool_or(list_transform({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) THEN 'non_finite' "
            f"WHEN len({v}) <> {dim} THEN 'wrong_dim' WHEN list_min({v}) = 0 AND list_max({v}) = 0 THEN 'zero' ELSE 'ok' END")


@query("embedding_validity", lambda: D.with_ctes(["fx_vectors"], []) + f"""
SELECT vec_id, {_status_sql()} AS status, CAST(len(vector) AS BIGINT) AS size FROM fx_vectors""")
def embedding_validity(spark, sf):
    v = fx.view(spark, sf, "fx_vectors").withColumn("vector", vf.to_vector("vector"))
    return vec.vector_checks(v, DIM).select("vec_id", "status", "size")


@query("embedding_dim", lambda: D.with_ctes(["fx_vectors"], []) + """
SELECT CAST(coalesce((SELECT d FROM (SELECT len(vector) AS d, count(*) AS n FROM fx_vectors WHERE len(vector) > 0 GROUP BY 1)
  ORDER BY n DESC, d LIMIT 1), 768) AS BIGINT) AS dim""")
def embedding_dim(spark, sf):
    return vec.embedding_dim(fx.view(spark, sf, "fx_vectors"))


def _file_no(col: str) -> F.Column:
    return F.regexp_extract(col, r"([0-9]+)", 1).cast("bigint")


def _keyed_chunks(spark, sf):
    """Every chunk, keyed by the number in its file name (the vector key)."""
    return I.chunks(spark, sf).withColumn("vec_id", _file_no("source_file"))


@query("chunk_vectors", lambda: D.std_ctes(extra=[("fx_vectors_", "SELECT 1")]).replace(
    "WITH fx_files AS", "WITH fx_vectors AS (" + fx.FX_VECTORS_DUCKDB.replace("{embeddings}", "embeddings").strip() + "),\nfx_files AS", 1) + f"""
SELECT c.chunk_id, v.vec_id, CASE WHEN v.vec_id IS NULL THEN 'missing' ELSE {_status_sql('v.vector')} END AS status
FROM chunks c LEFT JOIN fx_vectors v ON v.vec_id = CAST(regexp_extract(c.source_file, '([0-9]+)', 1) AS BIGINT)""")
def chunk_vectors(spark, sf):
    """Every chunk paired with the vector of its file's number; chunks
    without a vector are reported, not dropped with their batch."""
    paired = vec.pair_vectors(_keyed_chunks(spark, sf), fx.view(spark, sf, "fx_vectors"), key="vec_id")
    return paired.select("chunk_id", F.when(F.col("has_vector"), F.col("vec_id")).alias("vec_id"),
                         F.when(F.col("has_vector"), vf.vector_status("vector", DIM)).otherwise(F.lit("missing")).alias("status"))


@query("embedding_points", lambda: D.std_ctes(extra=[("fx_vectors_", "SELECT 1")]).replace(
    "WITH fx_files AS", "WITH fx_vectors AS (" + fx.FX_VECTORS_DUCKDB.replace("{embeddings}", "embeddings").strip() + "),\nfx_files AS", 1) + f"""
SELECT md5(c.repo_id || '/' || c.chunk_id) AS point_id, c.chunk_id, CAST(len(v.vector) AS INTEGER) AS dim
FROM chunks c JOIN fx_vectors v ON v.vec_id = CAST(regexp_extract(c.source_file, '([0-9]+)', 1) AS BIGINT)
WHERE {_status_sql('v.vector')} = 'ok'""")
def embedding_points(spark, sf):
    """Vector-store rows for the valid matched vectors."""
    vectors = vec.valid_vectors(fx.view(spark, sf, "fx_vectors"), DIM)
    matched = vec.pair_vectors(_keyed_chunks(spark, sf), vectors, key="vec_id").where("has_vector")
    pts = vec.embedding_points(matched, model="fixture-64")
    return pts.select("point_id", F.col("payload.chunk_id").alias("chunk_id"), F.col("payload.dim").alias("dim"))


@query("embed_chunks")
def embed_chunks(spark, sf):
    """Default embedder (hashing TF + L2 norm, JVM only) over every chunk."""
    e = vec.embed(I.chunks(spark, sf), dim=768)
    return e.select("chunk_id", F.size("vector").cast("bigint").alias("dim"),
                    F.round(F.array_max("vector"), 4).alias("max_weight"))
