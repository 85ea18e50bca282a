"""Column-role detection on header names (driver metadata only, no rows).

A catalog export is wide: one column per (measure, year).  Roles are found
by substring on the stripped header text, as the catalog exports name them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

# Header markers of the catalog export format.
SALES_MARKER = "Net Sales $"
QTY_MARKER = "Net Sales Q"
DEFAULT_YEARS = tuple(range(2016, 2025))

# The twelve optional category columns, in the export's order,
# with the snake_case names used in curated tables.
DIMENSIONS = (
    ("JJ: Reporting Type 2", "reporting_type"),
    ("BookType", "book_type"),
    ("Discipline", "discipline"),
    ("AcquisitionEditor", "acquisition_editor"),
    ("Edition Status", "edition_status"),
    ("c_ReportingProductType", "reporting_product_type"),
    ("CatalogPosition", "catalog_position"),
    ("PrincetonLegacyLibrary", "legacy_library"),
    ("CoPub", "copub"),
    ("Finance - Title counts type III", "title_counts_type"),
    ("Finance - IP Book Type", "ip_book_type"),
    ("HighInvestmentGroup", "high_investment_group"),
)
DIM_LABEL = {snake: label for label, snake in DIMENSIONS}

# Keyword lists of the loose (opt-in) role detection.
LOOSE_SALES_WORDS = ("sales", "revenue", "income", "$")
LOOSE_QTY_WORDS = ("quantity", "units", "copies", "q")


def dedup_names(names: Sequence[str | None]) -> list[str]:
    """pandas-style header names: blank -> ``Unnamed: i``; repeats -> ``a.1``, ``a.2``.

    Case matters (``net`` and ``Net`` are distinct), unlike Spark's own
    CSV renaming.
    """
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, raw in enumerate(names):
        name = raw if raw not in (None, "") else f"Unnamed: {i}"
        k = seen.get(name, 0)
        while k > 0:
            seen[name] = k + 1
            name = f"{name}.{k}"
            k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(name)
    return out


def years_in(name: str, years: Iterable[int]) -> list[int]:
    return [y for y in years if str(y) in name]


@dataclass(frozen=True)
class ColumnRoles:
    """Which header is which.  ``names`` are the stripped display headers in
    file order; ``sales`` / ``quantity`` are subsets of them."""

    names: tuple[str, ...]
    sales: tuple[str, ...]
    quantity: tuple[str, ...]
    years: tuple[int, ...] = DEFAULT_YEARS
    warnings: tuple[str, ...] = field(default=())

    def position(self, name: str) -> int:
        return self.names.index(name)

    def has(self, name: str) -> bool:
        return name in self.names

    def year_map(self, cols: Sequence[str]) -> dict[int, str]:
        """Year -> the *first* column in file order whose name contains it."""
        out: dict[int, str] = {}
        for y in self.years:
            for c in cols:
                if str(y) in c:
                    out[y] = c
                    break
        return out

    @property
    def sales_by_year(self) -> dict[int, str]:
        return self.year_map(self.sales)

    @property
    def quantity_by_year(self) -> dict[int, str]:
        return self.year_map(self.quantity)

    @property
    def series_years(self) -> list[int]:
        """Years that get a point in the yearly series (a sales column exists)."""
        return sorted(self.sales_by_year)

    def latest_sales(self) -> tuple[int, str] | None:
        """The "latest" sales column: each column is tagged with the highest
        year it contains, then ``(year, name)`` is sorted descending.  With two
        columns for one year this picks the lexicographically largest name,
        which can differ from ``sales_by_year`` (first in file order)."""
        tagged = []
        for c in self.sales:
            ys = years_in(c, sorted(self.years, reverse=True))
            if ys:
                tagged.append((ys[0], c))
        if not tagged:
            return None
        tagged.sort(reverse=True)
        return tagged[0]


def detect_roles(columns: Sequence[str], years: Sequence[int] = DEFAULT_YEARS,
                 mode: str = "strict", sales: Sequence[str] | None = None,
                 quantity: Sequence[str] | None = None) -> ColumnRoles:
    """Find sales / quantity columns.

    ``strict``: name contains the export marker and a year in ``years``
    (case-sensitive).  ``loose``: lower-cased keyword match (opt-in; ``q``
    matches very widely, overlaps are reported).  An explicit ``sales`` /
    ``quantity`` list overrides detection and is kept only where present.
    """
    names = tuple(c.strip() for c in columns)
    warnings: list[str] = []
    if sales is not None or quantity is not None:
        s = tuple(c for c in (sales or ()) if c in names)
        q = tuple(c for c in (quantity or ()) if c in names)
        dropped = [c for c in list(sales or ()) + list(quantity or ()) if c not in names]
        if dropped:
            warnings.append(f"ignored unknown columns: {dropped}")
    elif mode == "strict":
        s = tuple(c for c in names if SALES_MARKER in c and years_in(c, years))
        q = tuple(c for c in names if QTY_MARKER in c and years_in(c, years))
    elif mode == "loose":
        s = tuple(c for c in names if any(w in c.lower() for w in LOOSE_SALES_WORDS))
        q = tuple(c for c in names if any(w in c.lower() for w in LOOSE_QTY_WORDS))
        both = sorted(set(s) & set(q))
        if both:
            warnings.append(f"columns matched as both sales and quantity: {both}")
    else:
        raise ValueError(f"unknown role mode {mode!r}")
    roles = ColumnRoles(names, s, q, tuple(years), tuple(warnings))
    latest = roles.latest_sales()
    if latest is not None:
        y, col = latest
        first = roles.sales_by_year.get(y)
        if first is not None and first != col:
            warnings.append(f"year {y}: yearly series uses {first!r}, latest-year views use {col!r}")
            roles = ColumnRoles(names, s, q, tuple(years), tuple(warnings))
    return roles


def describe_roles(spark, roles: ColumnRoles):
    """Column inventory as a one-row DataFrame (metadata only)."""
    return spark.createDataFrame(
        [(len(roles.sales), len(roles.quantity), len(roles.names), roles.series_years,
          (roles.latest_sales() or (None, None))[1], list(roles.warnings))],
        "sales_columns int, quantity_columns int, total_columns int, series_years array<int>, "
        "latest_sales_column string, warnings array<string>")


def column_role(roles: ColumnRoles, name: str) -> str:
    """``sales <year>``, ``quantity <year>`` or ``description``."""
    for kind, years in (("sales", roles.sales_by_year), ("quantity", roles.quantity_by_year)):
        for y, c in years.items():
            if c == name:
                return f"{kind} {y}"
    return "description"
