"""Plan checks: built-ins only, pushdown, single-shuffle category analysis,
shuffle-free per-title projections."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(p: str) -> int:
    return p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") + \
        p.count("Exchange SinglePartition")


@pytest.fixture(scope="module")
def plans(spark):
    q = E.queries()
    return {k: plan(fn(spark, SF001)) for k, fn in q.items() if k != "ingest_catalog"}


def test_no_python_in_any_plan(plans):
    for name, p in plans.items():
        for marker in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
            assert marker not in p, (name, marker)


def test_latest_views_push_the_year_filter(plans):
    p = plans["category_analysis"]
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate,2001-01-01" in p
    # only the columns the view needs are read (quantity is not)
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in p


def test_category_analysis_one_aggregate_for_all_dimensions(spark, plans):
    # the titles (facts by title + join) and then ONE aggregate over all 12 dimensions
    from backlist.sources.testdata import tpch_catalog
    titles = plan(tpch_catalog(spark, SF001, years=[2001]).titles)
    assert plans["category_analysis"].count("Generate inline") == 1
    assert exchanges(plans["category_analysis"]) == exchanges(titles) + 2  # the aggregate and the final sort


def test_per_title_projection_adds_no_shuffle(spark, plans):
    from backlist.sources.testdata import tpch_catalog
    titles = plan(tpch_catalog(spark, SF001).titles)
    assert exchanges(plans["projections_by_title"]) == exchanges(titles)


def test_no_cartesian_products(plans):
    for name, p in plans.items():
        for marker in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            assert marker not in p, (name, marker)


def test_overlay_and_histogram_read_their_input_once(plans):
    """What both branches need is checkpointed: no line item is scanned again."""
    for name in ("projection_overlay", "sales_histogram"):
        assert "lineitem" not in plans[name] and "l_extendedprice" not in plans[name], name
