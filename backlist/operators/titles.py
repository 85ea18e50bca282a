"""Title-level views over the latest year: top titles, distribution,
quartiles, publication-year performance and a preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.functions.agg import money_sum_sql
from backlist.functions.fmt import money_text
from backlist.plans.guards import bounded_broadcast
from backlist.plans.quantiles import exact_quantiles
from backlist.session import checkpoint_root


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def top_titles(latest: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best-selling titles; ties keep the earlier row.  A top-k
    (TakeOrderedAndProject): each task keeps its own k, one task merges."""
    cols = ["title_key"] + _present(latest, ["imprint", "book_type", "discipline", "fiscal_year"])
    return (latest.orderBy(F.col("sales").desc(), F.col("row_id").asc()).limit(k)
            .select(*cols, "sales", money_text(F.col("sales")).alias("sales_text")))


def sales_histogram(latest: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed; every bin is
    returned (0-filled).  With min = max all titles fall in bin 0."""
    spark = latest.sparkSession
    # one column, computed once: the range and the counts read it
    checkpoint_root(spark)
    latest = latest.select("sales").checkpoint(eager=True)
    lo, hi = latest.agg(F.min("sales")).scalar(), latest.agg(F.max("sales")).scalar()
    width = hi - lo
    raw = F.floor((F.col("sales") - lo) * F.lit(float(bins)) / width)
    b = F.when(width > 0, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = latest.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("title_count"))
    step = (hi - lo) / F.lit(float(bins))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(bounded_broadcast(counts, bins), "bin", "left")   # one row per bin at most
            .select("bin", (lo + step * F.col("bin")).alias("bin_start"),
                    (lo + step * (F.col("bin") + F.lit(1))).alias("bin_end"),
                    F.coalesce(F.col("title_count"), F.lit(0)).alias("title_count")))


def quartile_comparison(latest: DataFrame, approx: bool = False, accuracy: int = 100_000) -> DataFrame:
    """Two rows, ``Top 25%`` (sales >= q75) and ``Bottom 25%`` (sales <= q25),
    with title count and mean sales.  Thresholds are exact linearly
    interpolated quantiles (a distributed sort); ``approx=True`` uses
    ``percentile_approx`` instead (one pass, bounded sketch, approximate).
    The tests are inclusive so the groups may overlap."""
    if approx:
        pa = F.percentile_approx("sales", [0.25, 0.75], accuracy)
        q = latest.agg(pa.alias("_q")).select(F.col("_q")[0].cast("double").alias("q25"),
                                             F.col("_q")[1].cast("double").alias("q75"))
    else:
        # two columns, computed once: the quantiles and the comparison read them
        checkpoint_root(latest.sparkSession)
        latest = latest.select("row_id", "sales").checkpoint(eager=True)
        q = exact_quantiles(latest, "sales", [0.25, 0.75], ["q25", "q75"], tiebreak="row_id")
    # both thresholds in one scalar subquery (one row by construction)
    thresholds = q.select(F.struct("q25", "q75")).scalar()
    q25, q75 = thresholds.getField("q25"), thresholds.getField("q75")
    s = F.col("sales")
    flagged = latest.select("sales", (s >= q75).alias("_top"), (s <= q25).alias("_bottom"))
    top, bottom = F.col("_top"), F.col("_bottom")
    g = flagged.agg(
        F.count_if(top).alias("nt"), F.expr(f"{money_sum_sql('CASE WHEN _top THEN sales END')} AS st"),
        F.count_if(bottom).alias("nb"), F.expr(f"{money_sum_sql('CASE WHEN _bottom THEN sales END')} AS sb"))
    g = g.select(q25.alias("q25"), q75.alias("q75"), "nt", "st", "nb", "sb")
    rows = F.array(
        F.struct(F.lit("Top 25%").alias("quartile"), F.col("q75").alias("threshold"),
                 F.col("nt").alias("title_count"), (F.col("st") / F.col("nt")).alias("avg_sales")),
        F.struct(F.lit("Bottom 25%").alias("quartile"), F.col("q25").alias("threshold"),
                 F.col("nb").alias("title_count"), (F.col("sb") / F.col("nb")).alias("avg_sales")))
    return g.select(F.inline(rows))


def pubyear_performance(latest: DataFrame, latest_year: int, min_year: int = 2010) -> DataFrame:
    """Latest-year sales and title count per publication year >= ``min_year``
    (the year filter runs before the group-by; NULL years drop out)."""
    return (latest.where(F.col("fiscal_year") >= min_year).groupBy("fiscal_year")
            .agg(F.expr(f"{money_sum_sql('sales')} AS total_sales_{latest_year}"),
                 F.count("title_key").alias("title_count"))
            .withColumnRenamed("fiscal_year", "publication_year")
            .orderBy("publication_year"))


def preview(titles: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` rows in file order; absent values shown as ``N/A``."""
    cols = ["title_key"] + _present(titles, ["book_type", "discipline", "imprint"])
    return (titles.orderBy("row_id").limit(n)
            .select(*[F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in cols]))

