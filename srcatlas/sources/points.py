"""Stored vector points: Parquet partitioned by repository, a row for each
point id.

``write_points`` replaces by point id: a point that is written again takes the
place of the stored one, other points of its repository stay. Only the
partitions of the repositories in the write are read and replaced. The table
is the ``vectors`` table that ``streaming.ingest`` cleans of chunks that are
gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import pruned_semi_join
from ..operators.vectors import valid_vectors
from ..session import drop_path, path_exists, scratch_table
from ..streaming.ingest import write_table


def read_points(spark: SparkSession, path: str, repo_ids: DataFrame | None = None) -> DataFrame:
    """The stored points, or those of the repositories in a stored
    ``repo_ids(repo_id)``."""
    points = spark.read.parquet(path)
    return points if repo_ids is None else pruned_semi_join(points, repo_ids)


def write_points(points: DataFrame, path: str, dim: int | None = None) -> None:
    """Add or replace the points of (point_id, repo_id, chunk_id, vector,
    payload). With ``dim`` vectors that are no valid vectors of that length
    are left out. A point id is one chunk of one repository; of several rows
    with one, the last by payload and vector is taken."""
    spark = points.sparkSession
    rows = points if dim is None else valid_vectors(points, dim)
    fresh, at = scratch_table(rows, "points")
    others = [c for c in fresh.columns if c != "point_id"]
    # an id that is there twice is rare: only those rows are compared
    twice = fresh.groupBy("point_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("point_id")
    picked = fresh.join(twice, "point_id", "left_semi").groupBy("point_id").agg(
        F.max(F.struct(*[F.col(c) for c in sorted(others, key=lambda c: (c != "payload", c))])).alias("m")).select(
        "point_id", *[F.col(f"m.{c}").alias(c) for c in others])
    one = fresh.join(twice, "point_id", "left_anti").unionByName(picked.select(*fresh.columns))
    ids, ids_at = scratch_table(fresh.select("repo_id").distinct(), "point-repos")
    if path_exists(spark, f"{path}/repo_id=*"):
        stored = pruned_semi_join(spark.read.schema(fresh.schema).parquet(path), ids)
        one = stored.join(fresh.select("point_id"), "point_id", "left_anti").select(*fresh.columns).unionByName(one)
    # the old partitions are read until the new ones are written
    whole, whole_at = scratch_table(one, "point-table")
    write_table(whole, path)
    for p in (at, ids_at, whole_at):
        drop_path(spark, p)
