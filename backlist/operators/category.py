"""Performance by category dimension for the latest year.

All inputs are per-title rows (``Catalog.latest()``: one row per title with
``sales``).  Every group-by drops NULL keys, as a pandas group-by does, and
aggregates map-side before its single shuffle, so a dominant category costs
no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.functions.agg import money_sum_sql
from backlist.functions.fmt import money_text, round_half_even
from backlist.sources.roles import DIM_LABEL


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def category_analysis(latest: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``dimension, category, total_sales, title_count, revenue_per_title`` for
    every present dimension in one job: the dimensions are unpivoted (narrow)
    and aggregated together with a single shuffle.  Sorted by dimension, then
    by sales, largest first."""
    dims = [d for d in dims if d in latest.columns]
    if not dims:
        raise ValueError("no category dimension present")
    pairs = F.array(*[F.struct(F.lit(DIM_LABEL.get(d, d)).alias("dimension"),
                               F.col(d).cast("string").alias("category")) for d in dims])
    long = latest.select("sales", F.inline(pairs)).where(F.col("category").isNotNull())
    g = long.groupBy("dimension", "category").agg(
        F.expr(f"{money_sum_sql('sales')} AS total_sales"), F.count(F.lit(1)).alias("title_count"))
    return g.select("dimension", "category", "total_sales", "title_count",
                    (F.col("total_sales") / F.when(F.col("title_count") == 0, F.lit(1))
                     .otherwise(F.col("title_count"))).alias("revenue_per_title")
                    ).orderBy("dimension", F.desc("total_sales"), "category")


def dimension_metrics(latest: DataFrame, dim: str, *, mean_name: str = "avg_sales",
                      count_name: str = "title_count", total_titles: bool = False,
                      order: str = "sales", top: int | None = None) -> DataFrame:
    """Sum, mean and count of latest sales per value of ``dim``, rounded to two
    decimals like the reports (numpy rounding).  ``total_titles`` adds the
    count of non-NULL title keys.  ``order='sales'`` sorts by the rounded sum
    descending (ties by key); ``top`` keeps the first rows of that order."""
    df = latest.where(F.col(dim).isNotNull())
    aggs = [F.expr(f"{money_sum_sql('sales')} AS _sum"), F.count("sales").alias(count_name)]
    if total_titles:
        aggs.append(F.count("title_key").alias("total_titles"))
    g = df.groupBy(dim).agg(*aggs)
    out = g.select(dim, round_half_even(F.col("_sum"), 2).alias("total_sales"),
                   round_half_even(F.col("_sum") / F.col(count_name), 2).alias(mean_name),
                   count_name, *(["total_titles"] if total_titles else []))
    if order == "sales":
        out = out.orderBy(F.col("total_sales").desc(), F.col(dim).asc())
    else:
        out = out.orderBy(F.col(dim).asc())
    return out.limit(top) if top else out


def editor_metrics(latest: DataFrame, top: int = 15) -> DataFrame:
    return dimension_metrics(latest, "acquisition_editor", mean_name="avg_sales_per_title",
                             count_name="active_titles", total_titles=True, top=top)


def editor_top10(latest: DataFrame) -> DataFrame:
    """First ten editors with money shown as text."""
    m = editor_metrics(latest, top=10)
    return m.select("acquisition_editor", money_text(F.col("total_sales")).alias("total_sales"),
                    money_text(F.col("avg_sales_per_title")).alias("avg_sales_per_title"),
                    "active_titles", "total_titles", F.col("total_sales").alias("_s")) \
        .orderBy(F.col("_s").desc(), F.col("acquisition_editor").asc()).drop("_s")


def format_performance(latest: DataFrame) -> DataFrame:
    return dimension_metrics(latest, "reporting_product_type", count_name="active_titles",
                             total_titles=True)


def catalog_position(latest: DataFrame) -> DataFrame:
    return dimension_metrics(latest, "catalog_position")


def legacy_performance(latest: DataFrame) -> DataFrame:
    return dimension_metrics(latest, "legacy_library", order="key")


def investment_groups(latest: DataFrame) -> DataFrame:
    return dimension_metrics(latest, "high_investment_group", order="key")


def value_counts(latest: DataFrame, dim: str) -> DataFrame:
    """Rows per non-NULL value, most frequent first."""
    return (latest.where(F.col(dim).isNotNull()).groupBy(dim)
            .agg(F.count(F.lit(1)).alias("title_count"))
            .orderBy(F.col("title_count").desc(), F.col(dim).asc()))


def sales_by(latest: DataFrame, dim: str, top: int | None = None) -> DataFrame:
    """Unrounded latest-sales total per non-NULL value, largest first."""
    out = (latest.where(F.col(dim).isNotNull()).groupBy(dim)
           .agg(F.expr(f"{money_sum_sql('sales')} AS total_sales"))
           .orderBy(F.col("total_sales").desc(), F.col(dim).asc()))
    return out.limit(top) if top else out


def edition_status_counts(latest: DataFrame) -> DataFrame:
    return value_counts(latest, "edition_status")


def edition_status_sales(latest: DataFrame) -> DataFrame:
    return sales_by(latest, "edition_status")


def top_disciplines(latest: DataFrame, k: int = 3) -> DataFrame:
    return sales_by(latest, "discipline", top=k)


def copub_comparison(latest: DataFrame, yes: str = "Yes", no: str = "No") -> DataFrame:
    """One row: title counts for co-published / not (0 when absent) and the
    rounded mean latest sales of each, given only when *both* groups exist."""
    is_yes, is_no = F.col("copub") == yes, F.col("copub") == no
    g = latest.agg(
        F.count_if(is_yes).alias("copub_titles"), F.count_if(is_no).alias("non_copub_titles"),
        F.expr(f"{money_sum_sql(f'CASE WHEN copub = {_sql_str(yes)} THEN sales END')} AS _sy"),
        F.expr(f"{money_sum_sql(f'CASE WHEN copub = {_sql_str(no)} THEN sales END')} AS _sn"))
    both = (F.col("copub_titles") > 0) & (F.col("non_copub_titles") > 0)
    return g.select(
        "copub_titles", "non_copub_titles",
        F.when(both, round_half_even(F.col("_sy") / F.col("copub_titles"), 2)).alias("copub_avg_sales"),
        F.when(both, round_half_even(F.col("_sn") / F.col("non_copub_titles"), 2))
        .alias("non_copub_avg_sales"))
