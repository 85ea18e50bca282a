"""The curated catalog: one wide row per title.

Keeping all years of a title on one row means the long (title, year) table
is a narrow ``inline`` away and every latest-year view is a plain column
selection -- no join between per-title and per-year data is ever needed.
On Parquet, selecting one year's column is column pruning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.sources.roles import DIMENSIONS

# Per-title descriptive columns other than the category dimensions.
TITLE_ATTRS = ("title_key", "work_ref", "imprint", "pub_date", "fiscal_year")


def sales_col(year: int) -> str:
    return f"sales_{year}"


def qty_col(year: int) -> str:
    return f"qty_{year}"


@dataclass(frozen=True)
class Catalog:
    """``titles`` columns: ``row_id`` (BIGINT, row ordinal), ``title_key``,
    the present category dimensions (snake_case STRING), ``imprint``,
    ``pub_date`` DATE, ``fiscal_year`` INT, ``sales_<y>`` / ``qty_<y>``
    DOUBLE for every series year, and ``latest_sales`` DOUBLE.  ``facts``, where
    the source has them, are the sparse ``row_id, year, net_sales, net_qty``
    rows that the wide ones were made of."""

    titles: DataFrame
    years: tuple[int, ...]
    latest_year: int | None
    dims: tuple[str, ...] = field(default=tuple(s for _, s in DIMENSIONS))
    warnings: tuple[str, ...] = ()
    facts: DataFrame | None = None

    def has(self, column: str) -> bool:
        return column in self.titles.columns

    def title_year(self, carry: Sequence[str] = ()) -> DataFrame:
        """Dense (title, year) rows: ``row_id, <carry>, year, net_sales, net_qty``.

        Every title has a row for every series year (zero when it sold
        nothing), so means and counts include non-selling titles.
        """
        points = ", ".join(f"named_struct('year', CAST({y} AS INT), 'net_sales', `{sales_col(y)}`, "
                           f"'net_qty', `{qty_col(y)}`)" for y in self.years)
        return self.titles.selectExpr("row_id", *[f"`{c}`" for c in carry], f"inline(array({points}))")

    def latest(self, extra: Sequence[str] = ()) -> DataFrame:
        """Per-title attributes plus ``sales`` = the latest-year sales column."""
        keep = ["row_id"] + [c for c in TITLE_ATTRS + tuple(self.dims) + tuple(extra)
                             if c in self.titles.columns]
        return self.titles.select(*keep, F.col("latest_sales").alias("sales"))

    def with_titles(self, titles: DataFrame) -> "Catalog":
        return Catalog(titles, self.years, self.latest_year, self.dims, self.warnings)
