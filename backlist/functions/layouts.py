"""One date layout for a whole column.

``01/02/2020`` alone doesn't say whether its month or its day comes first; the
other cells of its column usually do.  One aggregate over a table counts, for
each column and each contested layout, the cells that fit it; the layout that
fits most wins (the first named one if equal), and the column is parsed once,
with the winners and the layouts that nothing contests.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backlist.functions.clean import DATE_FORMATS, parse_date

# Layouts that share a shape, in order of preference.
CONTESTED = {
    r"^\d{1,2}/\d{1,2}/\d{4}$": ("M/d/yyyy", "d/M/yyyy"),
    r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$": ("M/d/yyyy H:mm", "d/M/yyyy H:mm"),
    r"^\d{1,2}-\d{1,2}-\d{4}$": ("M-d-yyyy", "d-M-yyyy"),
    r"^\d{1,2}\.\d{1,2}\.\d{4}$": ("d.M.yyyy", "M.d.yyyy"),
}
SHAPE_OF = {layout: shape for shape, layouts in CONTESTED.items() for layout in layouts}


@dataclass(frozen=True)
class Election:
    """``formats`` to parse the column with; ``n_cells`` have a contested shape,
    ``n_misfits`` of them don't fit the winner and read as missing."""

    formats: tuple[str, ...]
    n_cells: int
    n_misfits: int


def parse_elected(c: Column | str, formats: Sequence[str]) -> Column:
    """Date text -> DATE by the given layouts; other text is NULL."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    tries = [F.when(text.rlike(SHAPE_OF[f]), F.to_date(F.try_to_timestamp(text, F.lit(f)))) if f in SHAPE_OF
             else parse_date(text, [f]) for f in formats]
    return F.coalesce(*tries)


def layout_counts(cells: Mapping[str, Column]) -> list[Column]:
    """Aggregates: per column and contested shape the cells of that shape, and
    those that fit each of its layouts."""
    out = []
    for i, c in enumerate(cells.values()):
        text = F.trim(c)
        for j, (shape, layouts) in enumerate(CONTESTED.items()):
            out.append(F.count_if(text.rlike(shape)).alias(f"n_{i}_{j}"))
            out += [F.count_if(text.rlike(shape) & F.try_to_timestamp(text, F.lit(f)).isNotNull()).alias(f"fit_{i}_{j}_{k}")
                    for k, f in enumerate(layouts)]
    return out


def elected(names: Sequence[str], counts: Mapping[str, int]) -> dict[str, Election]:
    """The elections from the one row of ``layout_counts``."""
    out = {}
    for i, name in enumerate(names):
        formats = [f for f in DATE_FORMATS if f not in SHAPE_OF]
        cells = misfits = 0
        for j, layouts in enumerate(CONTESTED.values()):
            fits = [counts[f"fit_{i}_{j}_{k}"] for k in range(len(layouts))]
            formats.append(layouts[fits.index(max(fits))])
            cells += counts[f"n_{i}_{j}"]
            misfits += counts[f"n_{i}_{j}"] - max(fits)
        out[name] = Election(tuple(formats), cells, misfits)
    return out


def elect_layouts(df: DataFrame, cells: Mapping[str, Column]) -> dict[str, Election]:
    """One pass over ``df`` for all the date columns ``cells`` (runs it)."""
    return elected(list(cells), df.agg(*layout_counts(cells)).first().asDict()) if cells else {}
