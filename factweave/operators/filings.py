"""Filings: periods from facts, latest by form, selection, flags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S


def listing_order() -> list:
    """Latest first."""
    return [F.desc("filing_date"), F.desc("accession_number")]


def period_summary(facts: DataFrame) -> DataFrame:
    """(cik, accession_number, form, fiscal_year, fiscal_period, report_date): each filing's latest period and the
    latest end date among its facts of that period. One aggregation over all filings, then one over its groups."""
    told = facts.filter("fiscal_year is not null and fiscal_period is not null and accession_number is not null and form is not null")
    by_period = told.groupBy("cik", "accession_number", F.upper("form").alias("form"), "fiscal_year", F.upper("fiscal_period").alias("fiscal_period")).agg(F.max("end_date").alias("report_date"))
    rank = F.struct("fiscal_year", S.period_rank("fiscal_period"), F.coalesce("report_date", F.lit("0001-01-01").cast("date")), "fiscal_period")
    best = by_period.groupBy("cik", "accession_number", "form").agg(F.max_by(F.struct("fiscal_year", "fiscal_period", "report_date"), rank).alias("p"))
    return best.select("cik", "accession_number", "form", "p.*")


def latest_per_form(filings: DataFrame, *, first_seen: bool = False) -> DataFrame:
    """The latest filing of each company and form; of equal dates (or, with ``first_seen``, whatever the dates) the first listed."""
    order = [] if first_seen else [F.col("filing_date").desc()]
    w = Window.partitionBy("cik", "form_type").orderBy(*order, "pos", "accession_number")
    return filings.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def require_forms(filings: DataFrame, forms: Iterable[str] = schema.SUPPORTED_FORMS) -> None:
    """LookupError that names the forms without a filing."""
    have = {r[0] for r in filings.select("form_type").distinct().filter(F.col("form_type").isin(list(forms))).collect()}
    if missing := sorted(set(forms) - have):
        raise LookupError(f"no recent filing for {', '.join(missing)}")


def ordering(by: str) -> list:
    """One of three orders: ``selection`` (oldest first), ``report`` (form and date, latest first) or ``form`` (annual reports first)."""
    form = F.when(F.col("form_type") == "10-K", 0).when(F.col("form_type") == "10-Q", 1).otherwise(2)
    orders = {
        "selection": [F.col("filing_date"), F.col("accession_number")],
        "report": [F.desc("form_type"), F.desc("filing_date"), F.col("accession_number")],
        "form": [form, F.col("form_type"), F.desc("filing_date"), F.col("accession_number")],
    }
    return orders[by]


def ordered(filings: DataFrame, by: str) -> DataFrame:
    return filings.orderBy(*ordering(by))


def select_active(filings: DataFrame, accessions: DataFrame) -> DataFrame:
    """Filings with an active accession; for a company without any, its latest of each form."""
    chosen = filings.join(accessions, ["cik", "accession_number"], "left_semi")
    rest = filings.join(chosen.select("cik").distinct(), "cik", "left_anti")
    return chosen.unionByName(latest_per_form(rest))


def missing_accessions(filings: DataFrame, accessions: DataFrame) -> DataFrame:
    """Active accessions that the recent filings don't list."""
    return accessions.join(filings, ["cik", "accession_number"], "left_anti")


def new_accessions(selected: DataFrame, existing: DataFrame) -> DataFrame:
    return selected.select("cik", "accession_number").join(existing, ["cik", "accession_number"], "left_anti").distinct()


def describe_missing(missing: DataFrame) -> DataFrame:
    """(cik, n, message): the first five and how many more."""
    grouped = missing.groupBy("cik").agg(F.sort_array(F.collect_set("accession_number")).alias("a"))
    return grouped.select("cik", F.size("a").cast("long").alias("n"), S.shortened(F.col("a")).alias("message"))


def filing_id(accession: str = "accession_number"):
    """A filing's number, which its accession decides."""
    return F.xxhash64(F.upper(F.trim(accession)))


def build_filings(selected: DataFrame, facts: DataFrame, accessions: DataFrame, local_paths: DataFrame | None = None) -> DataFrame:
    """Filing rows with their period; a filing is active if its accession is, or if no fact names it.

    ``local_paths`` are (accession_number, local_path) of the copies that there are.
    """
    periods = period_summary(facts).withColumnRenamed("form", "form_type")
    active = accessions.select("cik", "accession_number", F.lit(True).alias("_active"))
    named = facts.filter("accession_number is not null").select("cik", "accession_number").distinct().withColumn("_named", F.lit(True))
    rows = selected.join(periods, ["cik", "accession_number", "form_type"], "left").join(active, ["cik", "accession_number"], "left").join(named, ["cik", "accession_number"], "left")
    if local_paths is None:
        rows = rows.withColumn("local_path", F.lit(None).cast("string"))
    else:
        rows = rows.join(local_paths.select("accession_number", "local_path"), "accession_number", "left")
    return rows.select(
        "cik", "accession_number", F.upper(F.trim("form_type")).alias("form_type"), "filing_date", "report_date", "fiscal_year", "fiscal_period", F.lit("SEC").alias("source"),
        "document_url", "local_path", (F.col("_active").isNotNull() | F.col("_named").isNull()).alias("is_active_window"), filing_id().alias("filing_id"), F.col("cik").cast("long").alias("company_id"),
    )


def of_record(filings: DataFrame) -> DataFrame:
    """(cik, accession_number, form, filing_date, primary_document, document_url) of stored filings.

    The document is named by the local copy, else by the address; the CIK is the accession's prefix: who filed it,
    which need not be the company.
    """
    address = F.rtrim(F.coalesce("document_url", F.lit("")), F.lit("/"))
    name = F.when(F.col("local_path").isNotNull(), S.base_name("local_path")).otherwise(S.base_name(address))
    return filings.select(
        agent_cik().alias("cik"), "accession_number", F.col("form_type").alias("form"), "filing_date", name.alias("primary_document"), F.coalesce("document_url", F.lit("")).alias("document_url")
    )


def find_filings(filings: DataFrame, accessions: DataFrame) -> DataFrame:
    """The filing of each accession (accession_number), its other columns null if there is none."""
    return accessions.select("accession_number").distinct().join(filings, "accession_number", "left")


def set_active(filings: DataFrame, accessions: DataFrame) -> DataFrame:
    """All flags off, then on for the given accessions."""
    on = accessions.select("cik", "accession_number", F.lit(True).alias("_on")).distinct()
    return filings.drop("is_active_window").join(on, ["cik", "accession_number"], "left").withColumn("is_active_window", F.col("_on").isNotNull()).drop("_on")


def list_filings(filings: DataFrame, cik: str, *, forms: Iterable[str] | None = None, active: bool | None = None) -> DataFrame:
    rows = filings.filter(F.col("cik") == cik)
    if forms is not None:
        rows = rows.filter(F.col("form_type").isin([f.upper() for f in forms]))
    if active is not None:
        rows = rows.filter(F.col("is_active_window") == active)
    return rows.orderBy(*listing_order())


def agent_cik(accession: str = "accession_number"):
    """The accession's prefix: who filed it, which need not be the company."""
    return F.split_part(F.col(accession), F.lit("-"), F.lit(1))
