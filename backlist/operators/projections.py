"""Sales projections for any number of series at once.

A series (one per key and metric) has at most ``P`` points, ``P`` being the
number of catalog years -- a bound known when the plan is built.  Each
series is laid out as positional columns ``x_1..x_P`` / ``y_1..y_P`` (point
``i`` is the i-th year of that series), so every method is a closed-form row
expression evaluated in a fixed order: no Python, no per-series model
object, and results that do not depend on how rows were shuffled.

Methods (``horizon`` future years after ``last_year``):

* linear -- ordinary least squares on the calendar year;
* polynomial -- least squares of degree ``min(2, n - 1)``;
* exponential_smoothing -- ``S_1 = y_1``, ``S_i = a*y_i + (1-a)*S_{i-1}``,
  trend ``(S_n - S_{n-2}) / 2`` (``S_n - S_{n-1}`` for two points), step ``i``
  is ``S_n + m*trend*i`` counted in *points* from the last one.

Confidence scales growth: model methods ``y_n + m*(pred - y_n)``, smoothing
scales the trend.  Model forecasts are floored at 0 for sales, quantity and
active titles; smoothing forecasts for all metrics.  Series with fewer than
two points give no rows; an all-zero series forecasts zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.functions.fmt import money_text
from backlist.operators.series import METRICS
from backlist.session import checkpoint_root
from backlist.sources.catalog import Catalog, qty_col, sales_col

# Method names, confidence multipliers, smoothing factor and the
# metrics whose model forecasts are floored at zero.
METHODS = ("linear", "polynomial", "exponential_smoothing")
CONFIDENCE = {"Conservative": 0.8, "Moderate": 1.0, "Optimistic": 1.2}
ALPHA = 0.3
FLOORED = ("total_sales", "total_quantity", "active_titles")
MAX_HORIZON = 5


# --------------------------------------------------------------------------
# front ends: build the positional frame (keys..., metric, n, x_i, y_i)
# --------------------------------------------------------------------------

def series_positions(series: DataFrame, keys: Sequence[str], points: int, center: int,
                     metrics: Sequence[str] = METRICS) -> DataFrame:
    """From a long series ``(keys..., year, <metrics>)`` (one row per key and
    year).  The position window is partitioned by the keys, and the pivot
    groups by (keys, metric): the window's partitioning already satisfies the
    group-by, so there is a single shuffle, and every group holds at most
    ``points`` rows."""
    k = [f"`{c}`" for c in keys]
    over = f"PARTITION BY {', '.join(k)}" if keys else ""
    s = series.selectExpr(*k, "year", *[f"`{m}`" for m in metrics],
                          f"row_number() OVER ({over} ORDER BY year) AS _k",
                          f"count(1) OVER ({over}) AS n")
    entries = ", ".join(f"named_struct('metric', '{m}', '_y', CAST(`{m}` AS DOUBLE))" for m in metrics)
    long = s.selectExpr(*k, "year", "_k", "n", f"inline(array({entries}))")
    x = f"CAST(year - {center} AS DOUBLE)"
    aggs = [F.expr("max(n) AS n")]
    aggs += [F.expr(f"max(CASE WHEN _k = {i} THEN {x} END) AS x_{i}") for i in range(1, points + 1)]
    aggs += [F.expr(f"max(CASE WHEN _k = {i} THEN _y END) AS y_{i}") for i in range(1, points + 1)]
    return long.groupBy(*keys, "metric").agg(*aggs)


def title_positions(catalog: Catalog, center: int) -> DataFrame:
    """Per-title series straight from the wide titles table: every title has
    every catalog year, so positions are the year columns and nothing is
    shuffled.  Metrics are a single title's yearly summary (active = 1 when
    it sold, revenue per title = its sales)."""
    years = list(catalog.years)

    def value(metric: str, y: int) -> str:
        sales = f"`{sales_col(y)}`"
        active = f"CASE WHEN {sales} > 0 THEN 1.0D ELSE 0.0D END"
        return {"total_sales": sales, "total_quantity": f"`{qty_col(y)}`", "active_titles": active,
                "revenue_per_title": f"{sales} / greatest({active}, 1.0D)"}[metric]

    entries = ", ".join(
        f"named_struct('metric', '{m}', " +
        ", ".join(f"'y_{i + 1}', CAST({value(m, y)} AS DOUBLE)" for i, y in enumerate(years)) + ")"
        for m in METRICS)
    xs = [f"{float(y - center)!r}D AS x_{i + 1}" for i, y in enumerate(years)]
    return catalog.titles.selectExpr("row_id", f"CAST({len(years)} AS BIGINT) AS n", *xs,
                                     f"inline(array({entries}))")


# --------------------------------------------------------------------------
# the fits: narrow row expressions over the positional frame
# --------------------------------------------------------------------------
# The formulas are generated as SQL expression text: one parse in the JVM per
# column instead of thousands of client-side Column calls.  Operand order is
# fixed (left-to-right sums over positions), so every engine evaluating the
# same text gets the same bits.

def _lit(v: float) -> str:
    return f"{float(v)!r}D"


def _at(cols: Sequence[str], idx: str) -> str:
    """cols[idx - 1] for a per-row position ``idx``."""
    return "CASE " + " ".join(f"WHEN {idx} = {i + 1} THEN {c}" for i, c in enumerate(cols)) + " END"


def _fit_columns(P: int, alpha: float) -> list[str]:
    xs = [f"coalesce(x_{i}, 0.0D)" for i in range(1, P + 1)]
    ys = [f"coalesce(nanvl(y_{i}, 0.0D), 0.0D)" for i in range(1, P + 1)]   # NaN counts as 0
    a, b = _lit(alpha), f"(1.0D - {_lit(alpha)})"
    S = [ys[0]]
    for y in ys[1:]:
        S.append(f"({a} * {y} + {b} * ({S[-1]}))")
    s_n, s_n1, s_n2 = _at(S, "n"), _at(S, "n - 1"), _at(S, "n - 2")
    absmax = f"greatest({', '.join(f'abs({y})' for y in ys)})" if P > 1 else f"abs({ys[0]})"
    return [
        f"{' + '.join(xs)} AS S1",
        f"{' + '.join(f'{x} * {x}' for x in xs)} AS S2",
        f"{' + '.join(f'{x} * {x} * {x}' for x in xs)} AS S3",
        f"{' + '.join(f'{x} * {x} * {x} * {x}' for x in xs)} AS S4",
        f"{' + '.join(ys)} AS T0",
        f"{' + '.join(f'{x} * {y}' for x, y in zip(xs, ys))} AS T1",
        f"{' + '.join(f'{x} * {x} * {y}' for x, y in zip(xs, ys))} AS T2",
        f"{_at(ys, 'n')} AS y_last", f"{ys[0]} AS y_first", f"{absmax} AS y_absmax",
        f"{s_n} AS s_n",
        f"CASE WHEN n >= 3 THEN (({s_n}) - ({s_n2})) / 2.0D ELSE ({s_n}) - ({s_n1}) END AS trend",
    ]


# least squares: line by the 2x2 normal equations, parabola by Cramer's rule
_COEF = [
    "try_divide(CAST(n AS DOUBLE) * T1 - S1 * T0, CAST(n AS DOUBLE) * S2 - S1 * S1) AS b1",
    "CAST(n AS DOUBLE) * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S2 * S3) + S2 * (S1 * S3 - S2 * S2) AS det",
]
_COEF2 = [
    "(T0 - b1 * S1) / CAST(n AS DOUBLE) AS a1",
    "try_divide(T0 * (S2 * S4 - S3 * S3) - S1 * (T1 * S4 - S3 * T2) + S2 * (T1 * S3 - S2 * T2), det) AS a2",
    "try_divide(CAST(n AS DOUBLE) * (T1 * S4 - S3 * T2) - T0 * (S1 * S4 - S2 * S3) + S2 * (S1 * T2 - T1 * S2), det) AS b2",
    "try_divide(CAST(n AS DOUBLE) * (S2 * T2 - S3 * T1) - S1 * (S1 * T2 - S2 * T1) + T0 * (S1 * S3 - S2 * S2), det) AS c2",
]


# the value of one (method, step) row: columns m (confidence multiplier), step
# and X (the centred year) come from the expansion, the others from the fit
_FALLBACK = "greatest(0.0D, y_last + ((y_last - y_first) / CAST(n - 1 AS DOUBLE) * m) * step)"  # repeated years
_LINE = "(a1 + b1 * X)"
_PRED = f"CASE WHEN kind = 'polynomial' AND n >= 3 THEN a2 + b2 * X + c2 * (X * X) ELSE {_LINE} END"
_MODEL = f"CASE WHEN pred IS NULL THEN {_FALLBACK} ELSE y_last + (pred - y_last) * m END"
_SMOOTH = "greatest(0.0D, s_n + (trend * m) * step)"


def _expanded(coef: DataFrame, keys: Sequence[str], levels: Sequence[str], methods: Sequence[str], *,
              last_year: int, center: int, horizon: int) -> DataFrame:
    """One row per series, level, method and step with its value.  The rows
    are generated first and valued by one short expression, so the generated
    code does not grow with levels, methods or steps."""
    entries = ", ".join(
        f"named_struct('confidence', '{level}', 'kind', '{method}', 'method', '{method.replace('_', ' ').title()}', "
        f"'m', {_lit(CONFIDENCE.get(level, 1.0))})" for level in levels for method in methods)
    fit = ["n", "a1", "b1", "a2", "b2", "c2", "y_last", "y_first", "y_absmax", "s_n", "trend"]
    each = (coef.selectExpr(*keys, "metric", *fit, f"inline(array({entries}))")
            .selectExpr("*", f"explode(sequence(1, {horizon})) AS _step"))
    each = each.selectExpr("*", f"CAST({last_year} + _step AS INT) AS year", "CAST(_step AS DOUBLE) AS step",
                           f"CAST({last_year - center} + _step AS DOUBLE) AS X").selectExpr("*", f"{_PRED} AS pred")
    floored = ", ".join(f"'{x}'" for x in FLOORED)
    value = (f"CASE WHEN y_absmax = 0.0D THEN 0.0D WHEN kind = 'exponential_smoothing' THEN {_SMOOTH} "
             f"WHEN metric IN ({floored}) THEN greatest({_MODEL}, 0.0D) ELSE {_MODEL} END")
    return each.selectExpr(*keys, "metric", "confidence", "method", "year", f"{value} AS value")


def project_positions(pos: DataFrame, keys: Sequence[str], points: int, *, last_year: int,
                      center: int, horizon: int = MAX_HORIZON,
                      confidence: str | Sequence[str] = "Moderate",
                      methods: Sequence[str] = METHODS, alpha: float = ALPHA) -> DataFrame:
    """Forecast rows ``keys..., [confidence,] method, metric, year, value``.

    ``confidence`` may be a list of levels: they are all computed from the
    same fitted coefficients in one pass (and a ``confidence`` column added).
    """
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must be 1..{MAX_HORIZON}")
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods {unknown}")
    levels = [confidence] if isinstance(confidence, str) else list(confidence)
    k = [f"`{c}`" for c in keys]
    # a series longer than the declared bound would lose points: fail loudly
    checked = pos.where(F.col("n") >= 2).selectExpr(
        *k, "metric", f"CASE WHEN n > {points} THEN raise_error('series has more than {points} points') "
                      f"ELSE n END AS n", *[f"x_{i}" for i in range(1, points + 1)],
        *[f"y_{i}" for i in range(1, points + 1)])
    stats = checked.selectExpr(*k, "metric", "n", *_fit_columns(points, alpha))
    coef = stats.selectExpr("*", *_COEF).selectExpr("*", *_COEF2)
    out = _expanded(coef, k, levels, methods, last_year=last_year, center=center, horizon=horizon)
    cols = ([F.col("confidence")] if not isinstance(confidence, str) else []) + \
        [F.col("method"), F.col("metric"), F.col("year"), F.col("value")]
    return out.select(*keys, *cols)


# --------------------------------------------------------------------------
# public API
# --------------------------------------------------------------------------

def middle(years: Sequence[int]) -> int:
    """The year that the fits are centred on."""
    return (min(years) + max(years)) // 2


def project(series: DataFrame, keys: Sequence[str] = (), *, years: Sequence[int], last_year: int,
            horizon: int = MAX_HORIZON, confidence: str = "Moderate",
            methods: Sequence[str] = METHODS, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Projections for every series of a ``yearly_summary`` output.

    ``years`` are the catalog's series years (their count bounds the points
    per series); ``last_year`` anchors the forecast years.  Returns
    ``keys..., method, metric, year, value``.
    """
    P = len(years)
    center = middle(years)
    pos = series_positions(series, keys, P, center, metrics)
    return project_positions(pos, keys, P, last_year=last_year, center=center, horizon=horizon,
                             confidence=confidence, methods=methods)


def project_titles(catalog: Catalog, *, last_year: int, horizon: int = MAX_HORIZON,
                   confidence: str = "Moderate", methods: Sequence[str] = METHODS) -> DataFrame:
    """Per-title projections with no shuffle at all (see ``title_positions``)."""
    center = middle(catalog.years)
    pos = title_positions(catalog, center)
    return project_positions(pos, ["row_id"], len(catalog.years), last_year=last_year,
                             center=center, horizon=horizon, confidence=confidence, methods=methods)


def project_confidence_levels(series: DataFrame, keys: Sequence[str] = (), *, years: Sequence[int],
                              last_year: int, horizon: int = MAX_HORIZON,
                              methods: Sequence[str] = METHODS, metrics: Sequence[str] = METRICS) -> DataFrame:
    """All three confidence levels, tagged, from one fit per series."""
    P = len(years)
    center = middle(years)
    pos = series_positions(series, keys, P, center, metrics)
    out = project_positions(pos, keys, P, last_year=last_year, center=center, horizon=horizon,
                            confidence=list(CONFIDENCE), methods=methods)
    return out.select("confidence", *keys, "method", "metric", "year", "value")


def projection_summary(projections: DataFrame, last_year: int, horizon: int,
                       offsets: Sequence[int] = (3, 5), metric: str = "total_sales") -> DataFrame:
    """Sales per method at ``last_year + offset`` (only offsets within the
    horizon), as money text, ``N/A`` where a method has no value."""
    targets = [last_year + o for o in offsets if o <= horizon]
    labels = [m.replace("_", " ").title() for m in METHODS]
    p = projections.where((F.col("metric") == metric) & F.col("year").isin(targets))
    wide = p.groupBy("year").pivot("method", labels).agg(F.first("value"))
    return wide.select("year", *[
        F.coalesce(money_text(F.col(f"`{lab}`")), F.lit("N/A")).alias(lab.lower().replace(" ", "_") + "_sales")
        for lab in labels])


def projection_overlay(yearly: DataFrame, projections: DataFrame,
                       metric: str = "total_sales") -> DataFrame:
    """History and each method's projection as one ``series, year, value``
    table (the data behind a multi-method chart)."""
    hist = yearly.select(F.lit("Historical Data").alias("series"), "year",
                         F.col(metric).cast("double").alias("value"))
    proj = projections.where(F.col("metric") == metric).select(
        F.concat(F.col("method"), F.lit(" Projection")).alias("series"), "year", "value")
    return hist.unionByName(proj)


def overlay(yearly: DataFrame, *, metric: str = "total_sales", **options) -> DataFrame:
    """``projection_overlay`` of a portfolio's series and its projections
    (``options`` of ``project``).  The series, a row for each year, is
    checkpointed, so what it is made of is read once for both."""
    checkpoint_root(yearly.sparkSession)
    yearly = yearly.checkpoint(eager=True)
    return projection_overlay(yearly, project(yearly, metrics=[metric], **options), metric)
