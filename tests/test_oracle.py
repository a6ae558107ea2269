"""Every registered query with an oracle equals its DuckDB statement at sf0.001."""
import math
import os

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

from srcatlas.plans import registry

# the optional subpackage has tests of its own
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in registry.QUERIES}
QUERIES = {k: v for k, v in E.queries().items() if k in registry.QUERIES}
_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "float": "FLOAT", "timestamp": "TIMESTAMP"}
TABLES = ["documents", "embeddings", "pages", "events", "conversations", "labels", "benchmark"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols[i] for i in order), sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(ORACLES[name])
    d_cols, d_rows = _rows(rel.columns, rel.fetchall())
    assert s_cols == d_cols
    s_types = {f.name: _TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert s_types == d_types
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"repo_id", "source_file", "n_chunks", "total_files"} <= set(df.columns)
