"""Joins of large tables with keys that few rows or very many may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to.
PARTS = 64


def salted_join(big: DataFrame, small: DataFrame, key: list[str], how: str, deal_by: str | list[str],
                parts: int = PARTS, wide: bool = False) -> DataFrame:
    """``big`` joined with ``small`` on ``key``; the rows of a key are dealt
    to ``parts`` parts by a hash of ``deal_by`` (columns of ``big``) and each
    part gets the key's rows of ``small``. So one key that holds a third of
    all rows is the work of many tasks, whatever shape the plan has.

    With ``wide`` the rows of ``small`` are copied only to the parts that hold
    a row of their key (found from the keys alone, in one more pass over
    them): for sides whose rows are too large to be copied for nothing.

    ``how`` is a join that keeps each row of ``big`` at its own part: inner,
    left, left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot deal out a {how} join")
    cols = [deal_by] if isinstance(deal_by, str) else deal_by
    dealt = big.withColumn("_part", F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int"))
    if wide:
        copies = small.join(dealt.select(*key, "_part").distinct(), key)
    else:
        copies = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    return dealt.join(copies, [*key, "_part"], how).drop("_part")


def pruned_semi_join(table: DataFrame, ids: DataFrame, key: str = "repo_id", prefix: str = "repo_") -> DataFrame:
    """The rows of ``table`` (stored, partitioned by ``key``) whose key is in
    ``ids``, reading only those partitions: with ``ids`` small enough to be
    broadcast, Spark prunes by what the broadcast holds (dynamic partition
    pruning). It does so only for a side that is filtered, so the ids' fixed
    ``prefix`` is stated as a filter. ``ids`` should be a stored table, whose
    size Spark knows; beyond the broadcast limit the join is a shuffle."""
    wanted = ids.where(F.col(key).startswith(prefix)).select(key).distinct()
    return table.join(wanted, key, "left_semi")
