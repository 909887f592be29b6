"""Text reports: figures and lines are made in Spark, the driver only strings the lines together."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import inventory


def _text(v) -> str:
    return "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v)


def text_table(df: DataFrame) -> list[str]:
    """A fixed-width table of all rows."""
    rows = [[_text(v) for v in r] for r in df.toLocalIterator()]
    width = [max(map(len, c)) for c in zip(df.columns, *rows)]
    return ["  ".join(x.ljust(n) for x, n in zip(r, width)).rstrip() for r in [df.columns, *rows]]


def markdown_table(df: DataFrame) -> list[str]:
    cells = df.select(*(S.cell(c).alias(c) for c in df.columns)).toLocalIterator()
    return [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}", *(f"| {' | '.join(r)} |" for r in cells)]


def _latest_first(fallback: Column) -> Column:
    """A period as something that a set can hold and sort."""
    unnamed = F.col("fiscal_year").isNull() & F.col("fiscal_period").isNull()
    label = S.period_label("fiscal_year", "fiscal_period", fallback)
    return F.struct(F.coalesce("fiscal_year", F.lit(0)).alias("fy"), S.period_rank("fiscal_period").alias("fp"), F.when(unnamed, fallback.cast("string")).alias("end"), label.alias("label"))


def _periods() -> Column:
    return F.transform(F.sort_array(F.collect_set(_latest_first(F.col("end_date"))), asc=False), lambda p: p["label"])


def section_lines(facts: DataFrame) -> DataFrame:
    """(section, place, line): facts by section and concept."""
    told = facts.withColumn("section", inventory.section_of(F.col("concept")))
    heads = told.groupBy("section").agg(F.count_distinct("taxonomy", "concept").alias("c"), F.count("*").alias("n"))
    heads = heads.select("section", F.lit("").alias("place"), F.concat(F.lit("- "), "section", F.lit(": "), S.counted("c", "concept"), F.lit(", "), S.counted("n", "stored fact")).alias("line"))
    rows = told.groupBy("section", F.concat_ws(":", "taxonomy", "concept").alias("place")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("unit")).alias("u"), _periods().alias("p"))
    line = F.concat(F.lit("  - "), "place", F.lit(": "), S.counted("n", "fact"), F.lit("; units: "), S.joined(F.col("u")), F.lit("; periods: "), S.joined(F.col("p"), 8))
    return heads.unionByName(rows.select("section", "place", line.alias("line")))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """(section, place, line): metrics by statement and name."""
    heads = inventory.statement_report(metrics)
    head = F.concat(F.lit("- "), S.title("statement_type"), F.lit(": "), S.counted("n_names", "metric name"), F.lit(", "), S.counted("n_values", "metric value"))
    heads = heads.select(F.col("statement_type").alias("section"), F.lit("").alias("place"), head.alias("line"))
    rows = metrics.groupBy(F.col("statement_type").alias("section"), F.col("metric_name").alias("place")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("unit")).alias("u"), _periods().alias("p"))
    line = F.concat(F.lit("  - "), "place", F.lit(": "), S.counted("n", "value"), F.lit("; units: "), S.joined(F.col("u")), F.lit("; periods: "), S.joined(F.col("p"), 8))
    return heads.unionByName(rows.select("section", "place", line.alias("line")))


def filing_lines(filings: DataFrame, facts: DataFrame) -> DataFrame:
    """(form_type, filing_date, accession_number, line): each filing with its facts, the first concepts and its file."""
    by_concept = facts.filter("accession_number is not null").groupBy("accession_number", "taxonomy", "concept", "unit").agg(F.count("*").alias("n"))
    told = F.concat(F.concat_ws(":", "taxonomy", "concept"), F.lit(" ["), "unit", F.lit("] ("), S.counted("n", "fact"), F.lit(")"))
    concepts = by_concept.groupBy("accession_number").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(told)).alias("c"))
    periods = facts.groupBy("accession_number").agg(_periods().alias("p"))
    rows = filings.join(concepts, "accession_number", "left").join(periods, "accession_number", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none = F.array().cast("array<string>")
    line = F.concat(
        F.lit("- "), "form_type", F.lit(" "), F.col("filing_date").cast("string"), F.lit(" "), "accession_number", F.lit(" ("), S.counted("n", "stored XBRL fact"),
        F.lit(", periods: "), S.joined(F.coalesce("p", none)), F.lit("): file: "), F.coalesce("local_path", F.lit("not downloaded")),
        F.lit("; concepts: "), F.when(F.col("n") == 0, "none found for this accession number").otherwise(S.joined(F.coalesce("c", none), 14)),
    )
    return rows.select("form_type", "filing_date", "accession_number", line.alias("line"))


def form_lines(facts: DataFrame) -> DataFrame:
    """(form, line): the stored periods of each report form."""
    rows = facts.filter(F.col("form").isin("10-K", "10-Q")).groupBy("form").agg(_periods().alias("p"))
    n = F.size("p")
    what = F.when(F.col("form") == "10-K", F.concat(F.lit(" XBRL annual periods in storage: "), S.counted(n, "fiscal year"))).otherwise(F.concat(F.lit(" XBRL quarterly periods in storage: "), S.counted(n, "fiscal quarter")))
    return rows.select("form", F.concat(F.lit("- "), "form", what, F.lit(": "), S.joined(F.col("p"), 12)).alias("line"))


def _lines(df: DataFrame, *order) -> Iterator[str]:
    for r in df.orderBy(*order).select("line").toLocalIterator():
        yield r.line


def ingestion_report(facts: DataFrame, metrics: DataFrame, filings: DataFrame, result=None) -> str:
    """The whole report of a company; ``result`` is what :func:`.company.ingest_company` gave, if it ran."""
    out: list[str] = []
    if result is not None:
        yes = lambda x: "yes" if x else "no"
        out += [f"Ticker: {result.ticker}", f"CIK: {result.cik}", f"Run status: {result.status}", f"SEC checked: {yes(result.sec_checked)}"]
        out += [f"Refresh due: 10-K={yes(result.refresh_due_10k)}, 10-Q={yes(result.refresh_due_10q)}", ""]
        out += [f"Normalized facts this run: {result.normalized_fact_count}", f"Stored facts this run: {result.stored_fact_count}"]
    total, concepts = facts.agg(F.count("*"), F.count_distinct("taxonomy", "concept")).first()
    out += [f"Total stored facts: {total}", f"XBRL concepts ingested: {concepts}", *_lines(form_lines(facts), "form"), "", "Facts by section"]
    out += [*(_lines(section_lines(facts), "section", "place") if total else ["- No XBRL financial facts found in storage."]), "", "Metrics of the active window"]
    out += [*_lines(metric_lines(metrics.filter("is_active_window")), "section", "place")] or ["- No active base financial metrics found."]
    out += ["", "Active filings by form", *text_table(inventory.filings_by_form(filings).orderBy("form_type")), "", "Filings and their facts"]
    out += [*_lines(filing_lines(filings, facts), F.desc("form_type"), F.desc("filing_date"), "accession_number")] or ["- No filings."]
    if result is not None and result.warnings:
        out += ["", "Warnings:", *(f"- {w}" for w in result.warnings)]
    return "\n".join(out)
