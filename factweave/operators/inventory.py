"""Inventories and reports as DataFrames."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from .metrics import fact_order, trace_sample


def section_of(concept: Column) -> Column:
    """The report section of a concept."""
    out = F
    for section, concepts in schema.SECTIONS.items():
        out = out.when(concept.isin(list(concepts)), F.lit(section))
    return out.otherwise(F.lit(schema.UNMAPPED_SECTION))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


def count_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    rows = after.withColumnRenamed("n_rows", "n_after").join(before.withColumnRenamed("n_rows", "n_before"), "table_name", "full")
    rows = rows.select("table_name", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return rows.withColumn("delta", F.col("n_after") - F.col("n_before"))


def filings_by_form(filings: DataFrame) -> DataFrame:
    """(form_type, n_active) for both report forms, zero without any."""
    forms = filings.sparkSession.createDataFrame([(f,) for f in schema.SUPPORTED_FORMS], "form_type string")
    counts = filings.filter("is_active_window").groupBy("form_type").agg(F.count("*").alias("n"))
    return forms.join(counts, "form_type", "left").select("form_type", F.coalesce("n", F.lit(0)).alias("n_active"))


def metrics_by_statement(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("statement_type").agg(F.count("*").alias("n_metrics"), F.count_if("is_active_window").alias("n_active"))


def metric_coverage(metrics: DataFrame) -> DataFrame:
    """(cik, metric_name, annual and quarterly periods)."""
    period = F.struct("fiscal_year", "fiscal_period")
    annual = F.col("fiscal_period") == "FY"
    return metrics.groupBy("cik", "metric_name").agg(F.count_distinct(F.when(annual, period)).alias("n_annual"), F.count_distinct(F.when(~annual, period)).alias("n_quarterly"))


def concept_inventory(facts: DataFrame) -> DataFrame:
    """(taxonomy, concept, section, counts, sorted units, forms and periods)."""
    label = S.period_label("fiscal_year", "fiscal_period", F.col("end_date"))
    grouped = facts.groupBy("taxonomy", "concept").agg(
        F.count("*").alias("n_facts"), F.array_sort(F.collect_set("unit")).alias("units"), F.array_sort(F.collect_set("form")).alias("forms"), F.array_sort(F.collect_set(label)).alias("periods")
    )
    return grouped.withColumn("section", section_of(F.col("concept")))


def statement_sections(facts: DataFrame) -> DataFrame:
    """(section, n_concepts, n_facts)."""
    return facts.groupBy(section_of(F.col("concept")).alias("section")).agg(F.count_distinct("taxonomy", "concept").alias("n_concepts"), F.count("*").alias("n_facts"))


def metric_report(metrics: DataFrame) -> DataFrame:
    """(statement_type, metric_name, n_values, units, periods) of each metric; a period in a set costs one entry."""
    label = S.period_label("fiscal_year", "fiscal_period", F.col("end_date"))
    return metrics.groupBy("statement_type", "metric_name").agg(F.count("*").alias("n_values"), F.array_sort(F.collect_set("unit")).alias("units"), F.array_sort(F.collect_set(label)).alias("periods"))


def statement_report(metrics: DataFrame) -> DataFrame:
    """(statement_type, n_names, n_values) of each statement."""
    return metrics.groupBy("statement_type").agg(F.count_distinct("metric_name").alias("n_names"), F.count("*").alias("n_values"))


def filing_facts(filings: DataFrame, facts: DataFrame) -> DataFrame:
    """(accession_number, taxonomy, concept, unit, n_facts); filings without facts have one row of zero."""
    counts = facts.groupBy("accession_number", "taxonomy", "concept", "unit").agg(F.count("*").alias("n"))
    return filings.select("accession_number", "form_type").join(counts, "accession_number", "left").withColumn("n_facts", F.coalesce("n", F.lit(0))).drop("n")


def period_coverage(facts: DataFrame) -> DataFrame:
    """(form, n_periods, periods latest first)."""
    rank = F.struct(F.coalesce("fiscal_year", F.lit(0)).alias("fy"), S.period_rank("fiscal_period").alias("p"), S.period_label("fiscal_year", "fiscal_period", F.col("end_date")).alias("label"))
    grouped = facts.groupBy("form").agg(F.sort_array(F.collect_set(rank), asc=False).alias("p"))
    return grouped.select("form", F.size("p").cast("long").alias("n_periods"), F.col("p.label").alias("periods"))


def accessions_per_form(filings: DataFrame, forms: tuple[str, ...] = schema.SUPPORTED_FORMS) -> DataFrame:
    """(cik, form_type, place, accession_number): each company's accessions of the report forms, latest first, a row for each."""
    listed = filings.filter(F.col("form_type").isin(list(forms))).groupBy("cik", "form_type", "accession_number").agg(F.max("filing_date").alias("filing_date"))
    latest = Window.partitionBy("cik", "form_type").orderBy(F.desc("filing_date"), F.desc("accession_number"))
    return listed.select("cik", "form_type", F.row_number().over(latest).alias("place"), "accession_number")


def fact_summary(facts: DataFrame) -> DataFrame:
    """(cik, n_facts, n_concepts, latest end_date, sorted flags) of each company."""
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("quality_flags"))))
    return facts.groupBy("cik").agg(F.count("*").alias("n_facts"), F.count_distinct("concept").alias("n_concepts"), F.max("end_date").alias("report_date"), flags.alias("flags"))


def export_csv(df: DataFrame, path: str, order: list[str | Column]) -> list[str]:
    """Files that follow one another in the given order, each with a header; arrays as JSON. A folder that can't be
    written gives a warning, not an error."""
    flat = df.orderBy(*order).select(*(F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    try:
        flat.write.mode("overwrite").csv(path, header=True)
    except (PySparkException, Py4JJavaError) as e:
        if not any(x in str(e) for x in ("IOException", "Mkdirs failed", "AccessControl", "FileAlreadyExists", "ParentNotDirectory", "TASK_WRITE_FAILED")):
            raise
        return [f"CSV export skipped for {path.rstrip('/').rsplit('/', 1)[-1]}: {str(e).splitlines()[0]}"]
    return []


def export_tables(companies: DataFrame, filings: DataFrame, facts: DataFrame, metrics: DataFrame, folder: str) -> list[str]:
    """Four whole tables and a sample of traced metrics below a folder; the warnings of those that couldn't be written."""
    metric_order = [F.col("statement_type"), F.col("metric_name"), F.desc("fiscal_year"), F.desc("fiscal_period")]
    first = companies.orderBy("cik").limit(1).select("cik")
    jobs = [
        ("companies", companies, ["cik"]),
        ("filings", filings, ["form_type", F.desc("filing_date")]),
        ("raw_xbrl_facts", facts, fact_order()),
        ("financial_metrics", metrics, metric_order),
        ("metric_traceability_sample", trace_sample(metrics.join(first, "cik", "left_semi"), facts, filings), metric_order),
    ]
    return [w for name, df, order in jobs for w in export_csv(df, f"{folder.rstrip('/')}/{name}.csv", order)]
