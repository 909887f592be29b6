"""Deterministic analytics over a series (cik, series, fiscal_year, fiscal_period, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .indicators import period_index


def metric_series(metrics: DataFrame, *, active_only: bool = True) -> DataFrame:
    """Chart-ready long rows, a value for each metric and period (the latest end date, then the least id)."""
    rows = metrics.filter("fiscal_year is not null and fiscal_period is not null")
    if active_only:
        rows = rows.filter("is_active_window")
    newest = F.max_by("value", F.struct(F.coalesce("end_date", F.lit("0001-01-01").cast("date")), "metric_id"))
    return rows.groupBy("cik", F.col("metric_name").alias("series"), "fiscal_year", "fiscal_period").agg(newest.alias("value"))


def chart_rows(series: DataFrame) -> DataFrame:
    return series.select("cik", "series", S.period_label("fiscal_year", "fiscal_period").alias("period"), "value")


def _ordered(series: DataFrame) -> tuple[DataFrame, Window]:
    kind = F.when(F.col("fiscal_period") == "FY", "annual").otherwise("quarterly")
    rows = series.withColumn("kind", kind).withColumn("i", period_index(F.col("fiscal_year"), F.col("fiscal_period")))
    return rows, Window.partitionBy("cik", "series", "kind").orderBy("i")


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def compare_periods(series: DataFrame) -> DataFrame:
    """Each period against the one right before it: absolute and percent change, NULL after a gap or from zero."""
    rows, w = _ordered(series)
    prior = F.when(F.lag("i").over(w) == F.col("i") - 1, F.lag("value").over(w))
    rows = rows.withColumn("prior_value", prior)
    change = F.col("value") - F.col("prior_value")
    return rows.select("cik", "series", "kind", "fiscal_year", "fiscal_period", "value", "prior_value", change.alias("absolute_change"), _ratio(change, F.abs(F.nullif("prior_value", F.lit(0)))).alias("percent_change"))


def trends(series: DataFrame) -> DataFrame:
    """(cik, series, kind, n_periods, direction from first to latest, latest, change from prior)."""
    told = compare_periods(series).withColumn("i", period_index(F.col("fiscal_year"), F.col("fiscal_period")))
    grouped = told.groupBy("cik", "series", "kind").agg(
        F.count("*").alias("n_periods"), F.min_by("value", "i").alias("_first"), F.max_by(F.struct("value", "absolute_change", "fiscal_year", "fiscal_period"), "i").alias("_l")
    )
    direction = F.when(F.col("n_periods") < 2, "single_period").when(F.col("_l.value") > F.col("_first"), "up").when(F.col("_l.value") < F.col("_first"), "down").otherwise("flat")
    return grouped.select("cik", "series", "kind", "n_periods", direction.alias("direction"), "_l.fiscal_year", "_l.fiscal_period", F.col("_l.value").alias("latest_value"), F.col("_l.absolute_change").alias("change_from_prior"))


def gaps(series: DataFrame) -> DataFrame:
    """Periods whose predecessor is missing, and how many are."""
    rows, w = _ordered(series)
    rows = rows.withColumn("n_missing", F.col("i") - F.lag("i").over(w) - 1).filter("n_missing > 0")
    return rows.select("cik", "series", "kind", "fiscal_year", "fiscal_period", "n_missing")


def outliers(series: DataFrame, *, threshold: float = 2.0) -> DataFrame:
    """Values further than ``threshold`` standard deviations of their series from its mean."""
    rows, _ = _ordered(series)
    w = Window.partitionBy("cik", "series", "kind")
    v = F.col("value").cast("double")
    score = F.round(F.try_divide(v - F.avg(v).over(w), F.stddev_pop(v).over(w)), 6)
    return rows.withColumn("z", score).filter(F.abs("z") > threshold).select("cik", "series", "kind", "fiscal_year", "fiscal_period", "value", "z")


def margin_steps(indicators: DataFrame) -> DataFrame:
    """What lies between gross, operating and net margin of each period."""
    of = lambda n: F.max(F.when(F.col("indicator_name") == n, F.col("value")))
    wide = indicators.groupBy("cik", "fiscal_year", "fiscal_period").agg(of("gross_margin").alias("gross"), of("operating_margin").alias("operating"), of("net_margin").alias("net"))
    return wide.withColumn("operating_cost_share", F.col("gross") - F.col("operating")).withColumn("below_operating_share", F.col("operating") - F.col("net"))


def benchmark_status(series: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(cik, series, benchmark_status, reason, n_compared, n_above) of each series against a benchmark (series,
    fiscal_year, fiscal_period, value); a comparison is refused where the benchmark holds none of its periods."""
    keys = ["series", "fiscal_year", "fiscal_period"]
    if benchmark is None:
        rows = series.select("cik", "series", F.lit(None).cast("double").alias("_b"), "value")
    else:
        told = benchmark.groupBy(*keys).agg(F.avg("value").alias("_b"))
        rows = series.join(told, keys, "left")
    rows = rows.groupBy("cik", "series").agg(F.count("_b").alias("n_compared"), F.count_if(F.col("value") > F.col("_b")).alias("n_above"))
    none = F.col("n_compared") == 0
    return rows.select("cik", "series", F.when(none, "refused").otherwise("compared").alias("benchmark_status"), F.when(none, "no benchmark data").alias("reason"), "n_compared", "n_above")
