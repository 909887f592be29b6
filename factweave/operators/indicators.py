"""Indicators from active metrics: one pivot for each period, then the registry's formulas.

A definition is data; all definitions compile into one select, so eight
indicators cost one aggregation and, for growth, one window over periods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION = "v1"


@dataclass(frozen=True)
class Indicator:
    name: str
    formula: str
    kind: str  # ratio, difference or growth
    top: str
    bottom: str
    period: str = "duration"


INDICATORS = (
    Indicator("revenue_growth", "(revenue - prior revenue) / abs(prior revenue)", "growth", "revenue", "revenue"),
    Indicator("gross_margin", "gross_profit / revenue", "ratio", "gross_profit", "revenue"),
    Indicator("operating_margin", "operating_income / revenue", "ratio", "operating_income", "revenue"),
    Indicator("net_margin", "net_income / revenue", "ratio", "net_income", "revenue"),
    Indicator("debt_ratio", "total_liabilities / total_assets", "ratio", "total_liabilities", "total_assets", "instant"),
    Indicator("current_ratio", "current_assets / current_liabilities", "ratio", "current_assets", "current_liabilities", "instant"),
    Indicator("free_cash_flow", "operating_cash_flow - abs(capital_expenditure)", "difference", "operating_cash_flow", "capital_expenditure"),
    Indicator("cash_conversion", "operating_cash_flow / net_income", "ratio", "operating_cash_flow", "net_income"),
)
_PERIOD = ("cik", "fiscal_year", "fiscal_period")


def period_index(fy: Column, fp: Column) -> Column:
    """Consecutive numbers for consecutive periods of one kind."""
    return F.when(fp == "FY", fy).otherwise(fy * 4 + F.substring(fp, 2, 1).cast("int"))


def choose_metrics(metrics: DataFrame, *, active_only: bool = True) -> DataFrame:
    """One row for each (period, metric_name): those with the latest end date, then the shortest duration in
    quarters and the longest in years; several values left are ambiguous."""
    rows = metrics.filter("fiscal_year is not null and fiscal_period is not null")
    if active_only:
        rows = rows.filter("is_active_window")
    days = F.coalesce(F.date_diff("end_date", "start_date"), F.lit(0))
    rank = F.struct(F.coalesce("end_date", F.lit("0001-01-01").cast("date")).alias("end"), F.when(F.col("fiscal_period") == "FY", days).otherwise(-days).alias("days"))
    told = F.struct("value", "unit", "period_type", "metric_id", "raw_fact_id", "accession_number", "filing_date", "is_active_window", "end_date")
    best = rows.withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(Window.partitionBy(*_PERIOD, "metric_name"))).filter("_rank = _best")
    grouped = best.groupBy(*_PERIOD, "metric_name").agg(
        F.count_distinct("value", "unit").alias("n_values"), F.min_by(told, "metric_id").alias("m")
    )
    return grouped.withColumn("m", F.when(F.col("n_values") == 1, F.col("m"))).withColumn("ambiguous", F.col("n_values") > 1).drop("n_values")


def calculate(metrics: DataFrame, *, active_only: bool = True) -> DataFrame:
    """A row for each period and indicator, calculated or skipped with the reason; reads and writes nothing."""
    chosen = choose_metrics(metrics, active_only=active_only)
    needed = sorted({n for i in INDICATORS for n in (i.top, i.bottom)})
    cells = [F.first(F.when(F.col("metric_name") == n, F.struct("m", "ambiguous")), ignorenulls=True).alias(n) for n in needed]
    wide = chosen.groupBy(*_PERIOD).agg(*cells)
    kind = F.when(F.col("fiscal_period") == "FY", "FY").otherwise("Q")
    before = Window.partitionBy("cik", kind).orderBy("_i")
    wide = wide.withColumn("_i", period_index(F.col("fiscal_year"), F.col("fiscal_period")))
    wide = wide.withColumn("_prior", F.when(F.lag("_i").over(before) == F.col("_i") - 1, F.lag("revenue").over(before)))
    # an array of structs, one for each definition, exploded once
    return wide.select(*_PERIOD, F.explode(F.array(*(_formula(i) for i in INDICATORS))).alias("r")).select(*_PERIOD, "r.*")


def _formula(i: Indicator) -> Column:
    top, low = F.col(i.top), F.col("_prior" if i.kind == "growth" else i.bottom)
    a, b = top["m"]["value"], low["m"]["value"]
    unclear = F.coalesce(top["ambiguous"], F.lit(False)) | F.coalesce(low["ambiguous"], F.lit(False))
    reason = F.when(unclear, "ambiguous_metric_set")
    if i.kind == "growth":
        reason = reason.when(a.isNull(), "missing_required_metric").when(b.isNull(), "missing_prior_period")
    else:
        reason = reason.when(a.isNull() | b.isNull(), "missing_required_metric")
    reason = reason.when((top["m"]["period_type"] != i.period) | (low["m"]["period_type"] != i.period), "period_type_mismatch")
    reason = reason.when(~top["m"]["unit"].eqNullSafe(low["m"]["unit"]), "unit_mismatch")
    if i.kind != "difference":
        reason = reason.when(b == 0, "zero_prior_period" if i.kind == "growth" else "zero_denominator")
    divide = lambda x, y: F.round(F.try_divide(x.cast("double"), y.cast("double")), 6).cast("decimal(38,10)")
    value = {"ratio": lambda: divide(a, b), "growth": lambda: divide(a - b, F.abs(b)), "difference": lambda: (a - F.abs(b)).cast("decimal(38,10)")}[i.kind]()
    sources = lambda f: F.array_sort(F.array_distinct(F.array_compact(F.array(top["m"][f], low["m"][f]))))
    return F.struct(
        F.lit(i.name).alias("indicator_name"), F.lit(i.formula).alias("formula_name"), F.lit(VERSION).alias("formula_version"),
        F.when(reason.isNull(), value).alias("value"), F.when(F.lit(i.kind == "difference"), top["m"]["unit"]).otherwise("ratio").alias("unit"), F.lit(i.period).alias("period_type"),
        F.coalesce(top["m"]["end_date"], low["m"]["end_date"]).alias("end_date"), F.greatest(top["m"]["filing_date"], low["m"]["filing_date"]).alias("filing_date"),
        sources("metric_id").alias("source_metric_ids"), sources("raw_fact_id").alias("source_raw_fact_ids"), sources("accession_number").alias("source_accession_numbers"),
        F.coalesce(top["m"]["is_active_window"], low["m"]["is_active_window"], F.lit(False)).alias("is_active_window"),
        F.when(reason.isNull(), "calculated").otherwise("skipped").alias("calculation_status"), reason.alias("skip_reason"),
    )


def numbered(indicators: DataFrame) -> DataFrame:
    """With ``batch_pos`` for a merge; keys are unique, so any order does."""
    return indicators.withColumn("batch_pos", F.col("fiscal_year").cast("long"))


def list_indicators(indicators: DataFrame, cik: str, *, names: list[str] | None = None, calculated: bool | None = None) -> DataFrame:
    rows = indicators.filter(F.col("cik") == cik)
    if names is not None:
        rows = rows.filter(F.col("indicator_name").isin(names))
    if calculated is not None:
        rows = rows.filter((F.col("calculation_status") == "calculated") == calculated)
    return rows.orderBy(*listing_order())


def listing_order() -> list:
    return [F.col("indicator_name"), F.desc("fiscal_year"), F.desc("fiscal_period"), F.col("formula_version")]


def summary(indicators: DataFrame) -> DataFrame:
    """(indicator_name, period kind, n_calculated, n_skipped)."""
    kind = F.when(F.col("fiscal_period") == "FY", "annual").otherwise("quarterly")
    done = F.col("calculation_status") == "calculated"
    return indicators.groupBy("indicator_name", kind.alias("period_kind"), "formula_version").agg(F.count_if(done).alias("n_calculated"), F.count_if(~done).alias("n_skipped"))
