from pyspark.sql import functions as F

from backlist.functions.fmt import pct_text
from backlist.operators import projections as prj
from backlist.operators.series import yearly_summary
from backlist.registry import LAST_YEAR, YEARS
from backlist.sources.catalog import Catalog
from backlist.sources.testdata import tpch_catalog
from tests.conftest import SF0001


def test_portfolio_series_needs_two_exchanges(spark):
    plan = yearly_summary(tpch_catalog(spark, SF0001))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan


def test_sparse_facts_give_the_series_of_the_dense_rows(spark):
    cat = tpch_catalog(spark, SF0001)
    dense = Catalog(cat.titles, cat.years, cat.latest_year, cat.dims)
    assert sorted(yearly_summary(cat).collect()) == sorted(yearly_summary(dense).collect())


def test_years_without_facts_count_as_zero(spark):
    facts = spark.createDataFrame([(1, 2000, 5.0, 2.0)], "row_id long, year int, net_sales double, net_qty double")
    titles = spark.createDataFrame([(1, 5.0)], "row_id long, latest_sales double")
    rows = {r["year"]: r for r in yearly_summary(Catalog(titles, (1999, 2000), 2000, facts=facts)).collect()}
    assert (rows[1999]["total_sales"], rows[1999]["active_titles"], rows[1999]["revenue_per_title"]) == (0.0, 0, 0.0)
    assert (rows[2000]["total_sales"], rows[2000]["total_quantity"], rows[2000]["active_titles"]) == (5.0, 2.0, 1)


def test_fits_are_centred_on_the_middle_year():
    assert prj.middle(YEARS) == 1998 and prj.middle([2001]) == 2001


def test_repeated_years_fall_back_to_the_mean_step(spark):
    # a series whose points share one year has no line through them
    row = [(2.0, 0.0, 0.0, 10.0, 14.0)]
    pos = spark.createDataFrame(row, "n double, x_1 double, x_2 double, y_1 double, y_2 double").selectExpr(
        "'total_sales' AS metric", "CAST(n AS BIGINT) AS n", "x_1", "x_2", "y_1", "y_2")
    out = prj.project_positions(pos, [], 2, last_year=LAST_YEAR, center=LAST_YEAR, horizon=2, methods=["linear"])
    assert [r["value"] for r in out.orderBy("year").collect()] == [18.0, 22.0]


def test_percent_text_of_null_is_null(spark):
    df = spark.createDataFrame([(None,), (12.25,), (-0.5,)], "x double")
    assert [r[0] for r in df.select(pct_text(F.col("x"))).collect()] == [None, "+12.2%", "-0.5%"]
