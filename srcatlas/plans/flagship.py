"""Flagship query: top files by chunk count per repository, with totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K
from ..operators import catalog as cat
from . import inputs as I


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    docs = I.documents(spark, sf)
    chunks = I.chunks(spark, sf)
    dist = cat.chunk_distribution(chunks, by="source_file", n=K.CHUNK_DISTRIBUTION_TOP)
    return dist.join(cat.repo_totals(docs, chunks), "repo_id")
