"""Ingestion as a pure function of landed documents, existing tables and a day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import companies, filings, merge, metrics, normalize, periods
from .staging import staged


@dataclass
class Ingested:
    """The new tables, and one summary row for each company."""

    facts: DataFrame
    filings: DataFrame
    metrics: DataFrame
    companies: DataFrame
    summary: DataFrame
    selected: DataFrame


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in (("facts", schema.FACTS), ("filings", schema.FILINGS), ("metrics", schema.METRICS), ("companies", schema.COMPANIES))}


def ingest(
    companyfacts: DataFrame, submissions: DataFrame, tickers: DataFrame, tables: dict[str, DataFrame], as_of: str, *, local_copy: Callable[[Row], str | None] | None = None
) -> Ingested:
    """Any number of companies at once; no table is touched, so a failure leaves no half-done state.

    Steps that several others read are staged in the shared folder, each worked
    out once. A company whose accessions are all known keeps its dates but is
    looked at again soon. ``local_copy`` gives the path of a selected filing's
    copy, which the driver makes: for one or a few companies at a time.
    """
    spark, stamp = companyfacts.sparkSession, F.lit(as_of).cast("timestamp")
    batch = normalize.normalize_companyfacts(companyfacts).withColumnRenamed("pos", "batch_pos").withColumn("batch_pos", F.col("batch_pos").cast("long"))
    batch = staged(batch.withColumn("created_at", stamp), "batch")
    facts = staged(merge.upsert(tables["facts"], batch, ["unique_key"], order="batch_pos").select(*tables["facts"].columns), "facts")
    keys = staged(periods.active_period_keys(facts), "keys")
    accessions = staged(periods.active_accessions(facts, keys), "accessions")
    recent = normalize.recent_filings(submissions)
    selected = staged(filings.select_active(recent, accessions), "selected")
    new = filings.new_accessions(selected, tables["filings"].select("cik", "accession_number"))
    copies = None
    if local_copy is not None:
        found = [(r.accession_number, local_copy(r)) for r in selected.toLocalIterator()]
        copies = spark.createDataFrame(found, "accession_number string, local_path string")
    built = filings.build_filings(selected, facts, accessions, copies).withColumn("ingested_at", stamp).withColumn("batch_pos", F.unix_date("filing_date"))
    built = staged(built, "built")
    # a filing that isn't selected any more is no longer active
    kept = [] if local_copy is not None else ["local_path"]
    all_filings = merge.upsert(tables["filings"], built, ["accession_number"], order="batch_pos", keep_first=kept).select(*tables["filings"].columns)
    mine = built.select("cik").distinct().withColumn("_mine", F.lit(True))
    chosen = built.select("accession_number", F.col("is_active_window").alias("_on"))
    all_filings = all_filings.join(mine, "cik", "left").join(chosen, "accession_number", "left")
    all_filings = all_filings.withColumn("is_active_window", F.when(F.col("_mine"), F.coalesce("_on", F.lit(False))).otherwise(F.col("is_active_window")))
    all_filings = staged(all_filings.select(*tables["filings"].columns), "filings")
    made = metrics.with_filings(metrics.base_metrics(facts, keys), all_filings).withColumn("created_at", stamp)
    made = staged(made.select(*tables["metrics"].columns), "metrics")
    all_metrics = tables["metrics"].join(made.select("cik").distinct(), "cik", "left_anti").unionByName(made)
    listed = normalize.ticker_map(tickers)
    rows = companies.build_companies(companies.company_profile(submissions), batch, listed, all_filings)
    known = tables["companies"].select("cik", F.lit(True).alias("_known"))
    n_new = new.groupBy("cik").agg(F.count("*").alias("n_new"))
    rows = rows.join(known, "cik", "left").join(n_new, "cik", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0))).withColumn("_known", F.col("_known").isNotNull())
    told = staged(rows.withColumn("status", companies.status(F.col("_known"), F.col("n_new"))), "told")
    waiting = companies.postpone_checks(told.filter("status = 'checked_no_update'"), as_of)
    now = told.filter("status <> 'checked_no_update'").unionByName(waiting)
    latest = F.greatest("latest_10k_filing_date", "latest_10q_filing_date")
    stamped = now.withColumn("created_at", stamp).withColumn("updated_at", stamp).withColumn("company_id", F.col("cik").cast("long")).withColumn("batch_pos", F.unix_date(latest))
    all_companies = merge.upsert(tables["companies"], stamped.select(*tables["companies"].columns, "batch_pos"), ["cik"], order="batch_pos", keep_first=["created_at"])
    all_companies = all_companies.select(*tables["companies"].columns)
    count = lambda df, n: df.groupBy("cik").agg(F.count("*").alias(n))
    summary = now.select("cik", "status", "n_new")
    for df, n in ((batch, "n_normalized"), (facts, "n_facts"), (built, "n_filings"), (made, "n_metrics"), (made.filter("is_active_window"), "n_active_metrics")):
        summary = summary.join(count(df, n), "cik", "left")
    flags = batch.select("cik", F.explode("quality_flags").alias("f")).groupBy("cik").agg(F.array_sort(F.collect_set("f")).alias("warnings"))
    summary = summary.join(flags, "cik", "left").join(filings.describe_missing(filings.missing_accessions(recent, accessions)).select("cik", F.col("message").alias("missing_filings")), "cik", "left")
    return Ingested(facts, all_filings, all_metrics, all_companies, summary.na.fill(0), selected)


def needs_refresh(tables: dict[str, DataFrame], identifier: str, as_of: str) -> bool:
    """Whether a ticker or CIK is unknown or due; checked before anything is fetched."""
    name = identifier.strip()
    known = tables["companies"].filter((F.upper("ticker") == name.upper()) | (F.col("cik") == F.lpad(F.lit(name), 10, "0")))
    row = companies.due_companies(known, as_of).first()
    return row is None or row.due


def health() -> dict[str, str]:
    return {"status": "ok"}
