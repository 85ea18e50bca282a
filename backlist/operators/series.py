"""Yearly series and their derived KPIs.

``yearly_summary`` is the portfolio series (``keys=()``) or one series per
key (category, title...).  Everything after it runs on at most one row per
(key, year), so the windows here are small per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backlist.functions.agg import money_sum_sql, pct_change
from backlist.functions.fmt import round_half_even
from backlist.sources.catalog import Catalog

METRICS = ("total_sales", "total_quantity", "active_titles", "revenue_per_title")


def _drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def _points(catalog: Catalog, keys: Sequence[str]) -> DataFrame:
    """Rows to add up per (keys, year).  The portfolio's series takes the sparse
    facts where there are any, and a zero row for each year: no pivot, no join."""
    if keys or catalog.facts is None:
        return _drop_null_keys(catalog.title_year(carry=keys), keys)
    years = ", ".join(f"CAST({y} AS INT)" for y in catalog.years)
    zeros = catalog.facts.sparkSession.range(1).selectExpr(
        f"explode(array({years})) AS year", "0.0D AS net_sales", "0.0D AS net_qty")
    return catalog.facts.select("year", "net_sales", "net_qty").unionByName(zeros)


def yearly_summary(catalog: Catalog, keys: Sequence[str] = ()) -> DataFrame:
    """Per (keys, year): total sales, total quantity, active titles (sales > 0)
    and revenue per active title (``sales / max(active, 1)``).

    Rows with a NULL key are left out, as a group-by on the key would.
    Partial aggregation runs before the shuffle, so a key that holds a large
    share of all titles still sends one row per task.
    """
    agg = _points(catalog, keys).groupBy(*keys, "year").agg(
        F.expr(f"{money_sum_sql('net_sales')} AS total_sales"),
        F.expr(f"{money_sum_sql('net_qty')} AS total_quantity"),
        F.expr("count_if(net_sales > 0) AS active_titles"))
    return agg.selectExpr(*[f"`{k}`" for k in keys], "year", "total_sales", "total_quantity",
                          "active_titles", "total_sales / greatest(active_titles, 1) AS revenue_per_title")


def yoy_growth(yearly: DataFrame, keys: Sequence[str] = (), drop_first: bool = False) -> DataFrame:
    """Percent change from the previous *row* of the series (not the previous
    calendar year) for sales and active titles; NULL on the first row and on
    a zero base."""
    w = Window.partitionBy(*keys).orderBy("year")
    out = yearly.select(
        *keys, "year", "total_sales", "active_titles",
        pct_change(F.col("total_sales"), F.lag("total_sales").over(w)).alias("sales_growth"),
        pct_change(F.col("active_titles").cast("double"),
                   F.lag("active_titles").over(w).cast("double")).alias("titles_growth"),
        F.row_number().over(w).alias("_pos"))
    if drop_first:
        out = out.where(F.col("_pos") > 1)
    return out.drop("_pos")


# Averages of a handful of DOUBLE growth rates depend on summation order in
# the last bits; they are reported rounded to 1e-9 percentage points.
GROWTH_DIGITS = 9


def growth_insights(yearly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total growth first -> last year and the mean of the yearly changes."""
    g = yoy_growth(yearly, keys)
    return g.groupBy(*keys).agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("n_years"),
        (F.try_divide(F.max_by("total_sales", "year") - F.min_by("total_sales", "year"),
                      F.min_by("total_sales", "year")) * F.lit(100.0)).alias("total_growth_pct"),
        round_half_even(F.avg("sales_growth"), GROWTH_DIGITS).alias("avg_growth_pct"),
    ).select(*keys, "first_year", "last_year", "n_years",
             F.when(F.col("n_years") > 1, F.col("total_growth_pct")).alias("total_growth_pct"),
             F.when(F.col("n_years") > 1, F.col("avg_growth_pct")).alias("avg_growth_pct"))


def portfolio_kpis(catalog: Catalog, yearly: DataFrame) -> DataFrame:
    """One row: title count, the last series year's sales, growth vs the
    previous row (NULL with fewer than two years or a zero base), active
    titles and revenue per title of the last year."""
    w = Window.orderBy(F.col("year").desc())
    last2 = yearly.select("year", "total_sales", "active_titles", "revenue_per_title",
                          F.row_number().over(w).alias("_rn")).where(F.col("_rn") <= 2)
    kpi = last2.agg(
        F.max(F.when(F.col("_rn") == 1, F.col("year"))).alias("latest_year"),
        F.max(F.when(F.col("_rn") == 1, F.col("total_sales"))).alias("latest_sales"),
        F.max(F.when(F.col("_rn") == 2, F.col("total_sales"))).alias("_prev"),
        F.max(F.when(F.col("_rn") == 1, F.col("active_titles"))).alias("active_titles"),
        F.max(F.when(F.col("_rn") == 1, F.col("revenue_per_title"))).alias("revenue_per_title"))
    total_titles = catalog.titles.agg(F.count(F.lit(1))).scalar()   # scalar subquery
    return kpi.select(
        total_titles.alias("total_titles"), "latest_year", "latest_sales",
        (F.try_divide(F.col("latest_sales") - F.col("_prev"), F.col("_prev")) * F.lit(100.0))
        .alias("sales_growth_pct"),
        "active_titles", "revenue_per_title")


def analysis_summary(kpis: DataFrame) -> DataFrame:
    """The four-row ``metric, value`` export; 0 where there is no series."""
    rows = [("Total Titles", F.col("total_titles").cast("double")),
            ("Latest Year Sales", F.col("latest_sales")),
            ("Active Titles", F.col("active_titles").cast("double")),
            ("Revenue per Title", F.col("revenue_per_title"))]
    entries = F.array(*[F.struct(F.lit(m).alias("metric"),
                                 F.coalesce(v, F.lit(0.0)).alias("value")) for m, v in rows])
    return kpis.select(F.inline(entries))
