"""The active window: the latest annual and quarterly periods of each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S


def active_period_keys(facts: DataFrame, *, years: int = schema.ACTIVE_YEARS, quarters: int = schema.ACTIVE_QUARTERS) -> DataFrame:
    """(cik, form, fiscal_year, fiscal_period) of the window; flagged facts count too.

    Keys are made distinct before they are ranked, so the window sees a few rows
    for each company.
    """
    form, fp = F.upper("form"), F.upper("fiscal_period")
    annual, quarterly = (form == "10-K") & (fp == "FY"), (form == "10-Q") & fp.rlike("^Q[1-4]$")
    keys = facts.filter(F.col("fiscal_year").isNotNull() & (annual | quarterly)).select("cik", form.alias("form"), "fiscal_year", fp.alias("fiscal_period")).distinct()
    latest = Window.partitionBy("cik", "form").orderBy(F.col("fiscal_year").desc(), S.period_rank("fiscal_period").desc())
    kept = F.when(F.col("form") == "10-K", F.lit(years)).otherwise(quarters)
    return keys.withColumn("_r", F.dense_rank().over(latest)).filter(F.col("_r") <= kept).drop("_r")


def _match(facts: DataFrame, keys: DataFrame) -> Column:
    return (facts.cik == keys.cik) & (F.upper(facts.form) == keys.form) & (facts.fiscal_year == keys.fiscal_year) & (F.upper(facts.fiscal_period) == keys.fiscal_period)


def mark_active(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """``facts`` with is_active_window."""
    tagged = keys.select(*(F.col(c).alias(f"_k_{c}") for c in keys.columns))
    on = (F.col("cik") == F.col("_k_cik")) & (F.upper("form") == F.col("_k_form")) & (F.col("fiscal_year") == F.col("_k_fiscal_year")) & (F.upper("fiscal_period") == F.col("_k_fiscal_period"))
    return facts.join(tagged, on, "left").withColumn("is_active_window", F.col("_k_cik").isNotNull()).drop(*tagged.columns)


def active_accessions(facts: DataFrame, keys: DataFrame) -> DataFrame:
    """(cik, accession_number) of filings with at least one active fact."""
    return facts.join(keys, _match(facts, keys), "left_semi").filter("accession_number is not null").select("cik", "accession_number").distinct()
