"""Aggregate expressions with run-to-run reproducible results.

Money is summed exactly, so totals do not depend on row order, partition
count or cluster size (a DOUBLE sum does).  Integer units of ``10**-scale``
are summed in two 64-bit lanes (high and low bits), which is as cheap as a
plain ``sum(bigint)`` yet cannot overflow even when one group holds hundreds
of billions of rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_SCALE = 4            # most money has at most four decimals
LANE_BITS = 20             # low lane < 2**20: 2**43 rows per group before it can overflow


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed_point(c: Column | str, scale: int) -> Column:
    """Integer units of ``10**-scale`` (BIGINT) for a DOUBLE with at most
    ``scale`` decimals -- exact for such values.  ``rint`` is a plain math
    call per row, unlike ``round`` or a DECIMAL cast."""
    return F.rint(_col(c) * F.lit(float(10 ** scale))).cast("bigint")


def fixed_sum(units: Column, scale: int) -> Column:
    """Exact sum of BIGINT ``units`` of ``10**-scale``, as DOUBLE."""
    hi = F.sum(F.shiftright(units, LANE_BITS))
    lo = F.sum(units.bitwiseAND(F.lit((1 << LANE_BITS) - 1)))
    total = hi.cast("decimal(38,0)") * F.lit(1 << LANE_BITS).cast("decimal(38,0)") + lo.cast("decimal(38,0)")
    return (total * F.lit(Decimal(1).scaleb(-scale))).cast("double")


def fixed_point_sql(v: str, scale: int) -> str:
    """``fixed_point`` as SQL text."""
    return f"CAST(rint({v} * {float(10 ** scale)}D) AS BIGINT)"


def fixed_sum_sql(units: str, scale: int) -> str:
    """``fixed_sum`` as SQL text."""
    hi, lo = f"sum(shiftright({units}, {LANE_BITS}))", f"sum({units} & {(1 << LANE_BITS) - 1})"
    total = f"CAST({hi} AS DECIMAL(38,0)) * CAST({1 << LANE_BITS} AS DECIMAL(38,0)) + CAST({lo} AS DECIMAL(38,0))"
    return f"CAST(({total}) * {Decimal(1).scaleb(-scale)}BD AS DOUBLE)"


def money_sum_sql(v: str) -> str:
    """Order-independent sum of a DOUBLE money column, as SQL text (one parse
    in the JVM instead of a chain of client-side calls).

    Every row's value counts as the decimal number that it prints as, and each
    row takes its own lane: values with at most four decimals are summed as
    integers (``rint`` divided back gives the value again), others as
    ``DECIMAL(38,16)``, and what no such decimal can hold (1e22 and more, inf,
    NaN) as DOUBLE.  No row's lane changes another row's.
    """
    units = f"rint({v} * 10000D)"
    short = f"coalesce(abs({v}) < 1e14D AND {units} / 10000D = {v}, false)"
    u = f"CASE WHEN {short} THEN CAST({units} AS BIGINT) END"
    exact = f"CASE WHEN NOT {short} THEN try_cast({v} AS DECIMAL(38,16)) END"
    huge = f"CASE WHEN NOT {short} AND try_cast({v} AS DECIMAL(38,16)) IS NULL THEN {v} END"
    lanes = (f"(CAST(sum(shiftright({u}, {LANE_BITS})) AS DECIMAL(38,0)) * CAST({1 << LANE_BITS} AS DECIMAL(38,0)) "
             f"+ CAST(sum({u} & {(1 << LANE_BITS) - 1}) AS DECIMAL(38,0))) * 0.0001BD")
    parts = (f"CAST({lanes} AS DECIMAL(38,16))", f"sum({exact})")
    whole = f"CAST(coalesce({parts[0]} + {parts[1]}, {parts[0]}, {parts[1]}) AS DOUBLE)"
    return f"coalesce({whole} + sum({huge}), {whole}, sum({huge}))"


def money_sum(name: str) -> Column:
    """``money_sum_sql`` of a column, given by its name."""
    return F.expr(money_sum_sql(f"`{name}`"))


def pct_change(cur: Column, prev: Column) -> Column:
    """pandas ``pct_change()*100``: ``(cur/prev - 1)*100``; NULL on a zero base.

    pandas yields inf/NaN for a zero base; NULL is the deliberate deviation
    (it also keeps such periods out of averages).
    """
    return (F.try_divide(cur, prev) - F.lit(1.0)) * F.lit(100.0)
