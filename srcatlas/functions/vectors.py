"""Vector expressions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_vector(values) -> Column:
    """Numeric array as ``ARRAY<FLOAT>``."""
    return F.transform(_c(values), lambda x: x.cast("float"))


def vector_status(vector, dim: int) -> Column:
    """First failing check of a vector, or ``ok``: null, empty, non-finite,
    wrong dimension, zero (it has no direction, so no cosine)."""
    v = _c(vector)
    # One ascending sort, no lambda (stays in generated code): nulls sort
    # first, NaN last, +inf just before NaN, -inf first among the values.
    srt = F.sort_array(v, asc=True)
    first, last = F.try_element_at(srt, F.lit(1)), F.try_element_at(srt, F.lit(-1))
    bad = (first.isNull() | F.isnan(last) | (last == F.lit(float("inf")))
           | (first == F.lit(float("-inf"))))
    return (F.when(v.isNull(), F.lit("null"))
            .when(F.size(v) == 0, F.lit("empty"))
            .when(bad, F.lit("non_finite"))
            .when(F.size(v) != dim, F.lit("wrong_dim"))
            .when((first == 0) & (last == 0), F.lit("zero"))
            .otherwise(F.lit("ok")))


def is_valid_vector(vector, dim: int) -> Column:
    return vector_status(vector, dim) == "ok"

