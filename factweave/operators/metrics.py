"""Facts to business metrics, each with the fact and filing it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from .periods import mark_active


def usable() -> Column:
    """Whether a fact may become a metric."""
    bad = F.array(*(F.lit(f) for f in schema.DISQUALIFYING))
    return F.col("accession_number").isNotNull() & F.col("form").isNotNull() & F.col("value").isNotNull() & ~F.arrays_overlap("quality_flags", bad)


def base_metrics(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """Usable facts of mapped concepts; the mapping has 14 rows and is broadcast."""
    mapping = facts.sparkSession.createDataFrame(schema.BASE_METRICS, "concept string, statement_type string, metric_name string")
    rows = mark_active(facts.filter(usable()).join(F.broadcast(mapping), "concept"), keys)
    return rows.select(
        F.sha2(F.concat_ws("|", "fact_id", "metric_name"), 256).alias("metric_id"),
        "cik", "accession_number", F.col("fact_id").alias("raw_fact_id"), "statement_type", "metric_name", "value", "value_raw", "unit", "period_type",
        "fiscal_year", F.upper("fiscal_period").alias("fiscal_period"), "start_date", "end_date", F.col("filed_date").alias("filing_date"), "is_active_window",
    )


def trace(metrics: DataFrame, facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Each metric with its raw fact and its filing, where they are known."""
    f = facts.select(F.col("fact_id").alias("raw_fact_id"), "taxonomy", "concept", F.col("value_raw").alias("fact_value_raw"))
    g = filings.select("accession_number", "form_type", F.col("filing_date").alias("filed_on"), "document_url")
    return metrics.join(f, "raw_fact_id", "left").join(g, "accession_number", "left")


def trace_sample(metrics: DataFrame, facts: DataFrame, filings: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` traced metrics in the order of a listing."""
    return trace(metrics, facts, filings).orderBy(*metric_order()).limit(n)


def with_filings(metrics: DataFrame, filings: DataFrame) -> DataFrame:
    """``metrics`` with the number of their filing, null where it isn't stored, and of their company."""
    known = filings.select("accession_number", "filing_id").distinct()
    return metrics.drop("filing_id", "company_id").join(known, "accession_number", "left").withColumn("company_id", F.col("cik").cast("long"))


def metric_order() -> list:
    return [F.col("statement_type"), F.col("metric_name"), F.desc("fiscal_year"), F.desc("fiscal_period"), F.desc("accession_number")]


def fact_order() -> list:
    return [F.col("concept"), F.col("end_date"), F.col("accession_number"), F.col("unit")]


def list_metrics(metrics: DataFrame, cik: str, *, statement: str | None = None, names: list[str] | None = None, active: bool | None = True) -> DataFrame:
    rows = metrics.filter(F.col("cik") == cik)
    if statement is not None:
        rows = rows.filter(F.col("statement_type") == statement)
    if names is not None:
        rows = rows.filter(F.col("metric_name").isin(names))
    if active is not None:
        rows = rows.filter(F.col("is_active_window") == active)
    return rows.orderBy(*metric_order())


def list_facts(facts: DataFrame, cik: str, concepts: list[str] | None = None) -> DataFrame:
    rows = facts.filter(F.col("cik") == cik)
    if concepts is not None:
        rows = rows.filter(F.col("concept").isin(concepts))
    return rows.orderBy(*fact_order())
