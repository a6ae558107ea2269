"""Vector operators: validity, dimension detection, chunk/vector join,
embedding, point rows.

The default embedder is Spark ML (tokenizer -> hashing TF -> L2 normaliser),
JVM-only. A custom embedder is any function ``list[str] -> list[list[float]]``
run batch-wise inside executors with ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import paths
from ..functions import vectors as vf


def vector_checks(df: DataFrame, dim: int, col: str = "vector") -> DataFrame:
    return df.withColumn("status", vf.vector_status(col, dim)).withColumn("size", F.size(col).cast("bigint"))


def valid_vectors(df: DataFrame, dim: int, col: str = "vector") -> DataFrame:
    return df.where(vf.is_valid_vector(col, dim))


def embedding_dim(vectors: DataFrame, col: str = "vector", default: int = K.EMBEDDING_DIM) -> DataFrame:
    """Most common non-zero vector length (ties -> smaller), ``default`` when there is none.
    Counting by length is a tiny partial aggregate; the mode is taken over
    the handful of distinct lengths."""
    counts = vectors.where(F.size(col) > 0).groupBy(F.size(col).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct("n", (-F.col("dim")).alias("neg"))).alias("b"))
    return best.select(F.coalesce(-F.col("b.neg"), F.lit(default)).cast("bigint").alias("dim"))


def pair_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Every chunk with its vector by key, or with ``has_vector`` false: one
    left join. Keyed instead of positional, so one bad vector never drops a
    whole batch."""
    marked = vectors.withColumn("_has", F.lit(True))
    return chunks.join(marked, key, "left").withColumn("has_vector", F.coalesce("_has", F.lit(False))).drop("_has")


def embedding_points(matched: DataFrame, model: str, repo_source_col: str = "repo_source") -> DataFrame:
    """Vector store rows: point id, the repository and chunk it is of, vector
    and payload."""
    dim = F.size("vector").cast("int")
    src = F.col(repo_source_col) if repo_source_col in matched.columns else F.lit("")
    return matched.select(
        paths.point_id(F.col("repo_id"), F.col("chunk_id")).alias("point_id"),
        "repo_id", "chunk_id", F.col("vector"),
        F.struct(F.col("chunk_id"), F.col("repo_id"), src.alias("repo_source"), F.lit(model).alias("model"),
                 dim.alias("dim"), dim.alias("chunk_size")).alias("payload"))


def _hashing_embedder(df: DataFrame, dim: int, text_col: str) -> DataFrame:
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[\p{L}\p{N}_]+", gaps=False, toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    norm = Normalizer(inputCol="_tf", outputCol="_v", p=2.0)
    out = norm.transform(tf.transform(tok.transform(df)))
    # A generator, through which no filter is pushed: a check on the vector
    # that moved below it would compute the vector again for each mention.
    return out.select(*df.columns, F.explode(F.array(vector_to_array("_v", "float32"))).alias("vector"))


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None = None,
          dim: int = K.EMBEDDING_DIM, text_col: str = "content", batch_size: int = 50) -> DataFrame:
    """Adds ``vector``; rows whose vector fails validation are dropped."""
    if embedder is None:
        out = _hashing_embedder(chunks, dim, text_col)
    else:
        schema = chunks.schema.add("vector", "array<float>")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), batch_size):
                    part = pdf.iloc[start:start + batch_size].copy()
                    part["vector"] = list(embedder(part[text_col].tolist()))
                    yield part
        out = chunks.mapInPandas(run, schema)
    return valid_vectors(out, dim)
