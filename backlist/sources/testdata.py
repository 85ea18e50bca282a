"""A catalog derived from the TPC-H-style test tables.

Titles are parts; a title's yearly net sales and quantity are the sums of
its line items per ship year.  Mapping (see FIXTURES.md, F4):

  row_id = p_partkey, title_key = 'w<partkey>_<partkey>', book_type = p_type,
  discipline = p_brand, editor = 'Editor <p_size>', and the other category
  columns from p_size / p_partkey / p_name residues; net sales =
  sum(decimal(18,2) price * decimal(4,2) (1 - discount)).

Titles are densified: parts without line items in a year sell nothing then.
Line items refer to parts, so the portfolio's series needs no join with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backlist.functions.agg import fixed_point_sql, fixed_sum_sql
from backlist.sources.catalog import Catalog, qty_col, sales_col
from backlist.sources.roles import DIMENSIONS

FIRST_YEAR, LAST_YEAR = 1995, 2001


# The plans are given as SQL text: one parse in the JVM instead of a client
# call for every operator.
TITLE_DIM = (
    "p_partkey AS row_id", "concat('w', p_partkey, '_', p_partkey) AS title_key", "concat('w', p_partkey) AS work_ref",
    "CASE WHEN p_partkey % 2 = 0 THEN 'a. Print' ELSE 'b. eBook' END AS reporting_type",
    "p_type AS book_type", "p_brand AS discipline", "concat('Editor ', p_size) AS acquisition_editor",
    "CASE p_size % 4 WHEN 0 THEN 'New' WHEN 1 THEN 'Revised' WHEN 2 THEN 'Reissue' END AS edition_status",
    "concat('Format ', p_size % 7) AS reporting_product_type", "concat('Slot ', p_size % 5) AS catalog_position",
    "CASE WHEN p_size > 40 THEN 'Y' ELSE 'N' END AS legacy_library",
    "CASE p_size % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS copub",
    "concat('Class ', p_partkey % 3) AS title_counts_type", "split_part(p_name, ' ', 2) AS ip_book_type",
    "concat('Group ', p_partkey % 6) AS high_investment_group", "concat('Publisher ', p_partkey % 9) AS imprint",
    "make_date(1980 + p_size, 1 + p_partkey % 12, 1 + p_partkey % 28) AS pub_date",
    "CAST(1980 + p_size AS INT) AS fiscal_year",
)
DIM_COLUMNS = tuple(e.rpartition(" AS ")[2] for e in TITLE_DIM)


def title_dim(part: DataFrame) -> DataFrame:
    """One row per part with the catalog's descriptive columns."""
    return part.selectExpr(*TITLE_DIM)


def title_year_facts(lineitem: DataFrame, years: Sequence[int]) -> DataFrame:
    """Sparse ``(row_id, year, net_sales, net_qty)`` from line items.

    The ship-date range is a plain comparison so it reaches the Parquet scan.
    Money is summed exactly in fixed point: cents x discount percent (both
    exact integers for the 2-decimal source values) in units of 1e-4, which
    equals ``decimal(18,2) * decimal(4,2)`` without per-row decimal casts.
    The aggregate is combined map-side before the shuffle, so a part that
    owns a large share of all line items costs one row per task.
    """
    keep = f"l_shipdate >= DATE '{min(years)}-01-01' AND l_shipdate < DATE '{max(years) + 1}-01-01'"
    if len(years) != max(years) - min(years) + 1:
        keep += f" AND year(l_shipdate) IN ({', '.join(map(str, years))})"
    facts = lineitem.where(keep).selectExpr(
        "l_partkey AS row_id", "year(l_shipdate) AS year",
        f"{fixed_point_sql('l_extendedprice', 2)} * {fixed_point_sql('(1.0D - l_discount)', 2)} AS amount",
        f"{fixed_point_sql('l_quantity', 2)} AS qty")
    keys = ["row_id"] if len(years) == 1 else ["row_id", "year"]
    out = facts.groupBy(*keys).agg(F.expr(f"{fixed_sum_sql('amount', 4)} AS net_sales"),
                                   F.expr(f"{fixed_sum_sql('qty', 2)} AS net_qty"))
    return out if len(years) > 1 else out.selectExpr("*", f"{years[0]} AS year")


def tpch_catalog(spark: SparkSession, sf_dir: str, first_year: int = FIRST_YEAR,
                 last_year: int = LAST_YEAR, years: Sequence[int] | None = None) -> Catalog:
    """Wide catalog over ``years`` (default: all of first..last).

    Views that need only the latest year pass ``years=[last_year]``: the
    line-item scan then reads one year's rows and the result is identical.
    """
    years = tuple(sorted(years or range(first_year, last_year + 1)))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    facts = title_year_facts(lineitem, years)
    if len(years) == 1:
        # one year: the facts are already one row per title
        y = years[0]
        wide = facts.selectExpr("row_id", f"net_sales AS {sales_col(y)}", f"net_qty AS {qty_col(y)}")
    else:
        # one row per title with a column pair per year (at most len(years)
        # rows per title feed it, so no title is a hot key here)
        wide = facts.groupBy("row_id").agg(*[F.expr(e) for y in years for e in (
            f"max(CASE WHEN year = {y} THEN net_sales END) AS {sales_col(y)}",
            f"max(CASE WHEN year = {y} THEN net_qty END) AS {qty_col(y)}")])
    joined = title_dim(part).join(wide, "row_id", "left")
    measures = [f"coalesce({c}, 0.0D) AS {c}" for y in years for c in (sales_col(y), qty_col(y))]
    latest = f"coalesce({sales_col(last_year)}, 0.0D)" if last_year in years else "CAST(NULL AS DOUBLE)"
    titles = joined.selectExpr(*DIM_COLUMNS, *measures, f"{latest} AS latest_sales")
    return Catalog(titles, years, last_year if last_year in years else max(years),
                   tuple(s for _, s in DIMENSIONS), facts=facts)
