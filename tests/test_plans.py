"""Physical-plan checks: the shapes the operators are designed to produce."""
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E

from srcatlas.plans import registry

# the optional subpackage has tests of its own
QUERIES = {k: v for k, v in E.queries().items() if k in registry.QUERIES}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["chunk_distribution", "top_samples", "keywords_tfidf", "context_report"])
def test_topk_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in _plan(QUERIES[name](spark, SF_SMALL))


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(QUERIES["review_scores"](spark, SF_SMALL))
    schema_lines = [l for l in plan.splitlines() if "ReadSchema" in l]
    assert schema_lines and all("text" not in l and "lang" not in l for l in schema_lines)


def test_no_python_udf_in_sql_expressible_queries(spark):
    for name in set(E.oracle_sql()) & set(QUERIES):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_building_a_query_starts_no_job(spark):
    from srcatlas.plans import registry
    registry.load_all()
    sc = spark.sparkContext
    for name, build in registry.QUERIES.items():
        sc.setJobGroup(f"build-{name}", name)
        build(spark, SF_SMALL).schema
        started = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        # reading a table's schema from its footer is a job of one stage
        assert all(len(sc.statusTracker().getJobInfo(j).stageIds) == 1 for j in started), name
        assert not any(sc.statusTracker().getStageInfo(s) and sc.statusTracker().getStageInfo(s).numTasks > 1
                       for j in started for s in sc.statusTracker().getJobInfo(j).stageIds), name


def test_hot_terms_and_texts_are_dealt_to_parts(spark):
    """Half of all rows on one key, broadcasts off: no task of the join holds
    them all, and the results are those of the unsplit data."""
    from pyspark.sql import functions as F
    from srcatlas.operators import keywords as kw
    rows = [(i, "alpha beta gamma" if i % 2 else f"word{i} alpha delta{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (kw.keywords_corpus(docs), kw.memoize_by_text(docs, lambda d: kw.keywords(d))):
            assert "_part" in _plan(df)
            assert df.select("doc_id").distinct().count() == 400
        salted = docs.where("text like '%alpha%'").select(F.pmod(F.xxhash64("doc_id"), F.lit(kw.SALTS)).alias("s")).groupBy("s").count().collect()
        assert len(salted) == kw.SALTS and max(r["count"] for r in salted) < 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_tokenising_pass_over_the_corpus(spark):
    plan = _plan(QUERIES["keywords_corpus"](spark, SF_SMALL))
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_one(spark, how):
    from srcatlas.operators.joins import salted_join
    big = spark.createDataFrame([("hot" if i % 2 else f"k{i % 7}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("k2", 2), ("zz", 3)], "k string, v int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, want = (sorted(map(str, df.collect())) for df in (salted_join(big, small, ["k"], how, "i"), big.join(small, "k", how)))
        assert got == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], "full", "i")
