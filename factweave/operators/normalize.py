"""Source documents to typed, flagged facts.

Structural damage (a missing object, a wrong JSON type, a CIK that isn't a
number) raises; a bad value in a fact is flagged and the row kept.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S
from ..sources.http import TickerNotFound


def require(holds: Column, message: str, value: Column) -> Column:
    """``value``, or an error that ends the job."""
    return F.when(F.coalesce(holds, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def ticker_map(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """(ticker, cik, title) of {index: {cik_str, ticker, title}} documents; of repeated tickers the last index holds."""
    parsed = documents.select(F.from_json(json_col, schema.TICKERS).alias("m"))
    entries = parsed.select(F.explode(require(F.col("m").isNotNull(), "ticker mapping must be a JSON object", F.col("m"))).alias("k", "e"))
    ticker, cik = F.upper(S.optional_text("e.ticker")), S.normalize_cik("e.cik_str")
    entries = entries.select(
        F.col("k").try_cast("long").alias("k"),
        require(ticker.isNotNull(), "ticker entry without ticker", ticker).alias("ticker"),
        require(cik.isNotNull(), "ticker entry without a numeric CIK", cik).alias("cik"),
        S.optional_text("e.title").alias("title"),
    )
    return entries.groupBy("ticker").agg(F.max_by(F.struct("cik", "title"), "k").alias("e")).select("ticker", "e.*")


def resolve_ticker(tickers: DataFrame, ticker: str) -> str:
    """The CIK of a ticker; LookupError if there is none."""
    if not ticker.strip():
        raise ValueError("ticker must not be blank")
    row = tickers.filter(F.col("ticker") == ticker.strip().upper()).select("cik").first()
    if row is None:
        raise TickerNotFound(f"ticker not found: {ticker}")
    return row.cik


def recent_filings(documents: DataFrame, forms: Iterable[str] = schema.SUPPORTED_FORMS, json_col: str = "json") -> DataFrame:
    """(cik, accession_number, form_type, filing_date, document, document_url, pos) of the wanted forms' recent filings."""
    parsed = documents.select(F.from_json(json_col, schema.SUBMISSIONS).alias("d"))
    r = "d.filings.recent"
    parts = ["accessionNumber", "filingDate", "form", "primaryDocument"]
    whole = F.col(r).isNotNull()
    for p in parts:
        whole &= F.size(f"{r}.{p}") == F.size(f"{r}.form")
    cik = S.normalize_cik("d.cik")
    rows = parsed.select(
        cik.alias("cik"),
        F.posexplode(
            require(
                cik.isNotNull(), "submissions without a numeric CIK",
                require(whole, "recent filings are missing or their arrays differ in length", F.arrays_zip(*(F.col(f"{r}.{p}").alias(p) for p in parts))),
            )
        ).alias("pos", "f"),
    )
    wanted = rows.withColumn("form_type", F.upper(F.trim("f.form"))).filter(F.col("form_type").isin([x.upper() for x in forms]))
    need = lambda c, n: require(S.optional_text(c).isNotNull(), f"recent filing without {n}", S.optional_text(c)).alias(n)
    named = wanted.select("cik", need("f.accessionNumber", "accession_number"), "form_type", S.parse_date("f.filingDate").alias("filing_date"), need("f.primaryDocument", "document"), "pos")
    return named.withColumn("document_url", S.document_url("cik", "accession_number", "document"))


def flatten_companyfacts(documents: DataFrame, *, taxonomies: Iterable[str] | None = None, concepts: Iterable[str] | None = None, json_col: str = "json") -> DataFrame:
    """Entries of taxonomy -> concept -> unit -> [entry] documents; filtered keys are dropped before they are exploded."""
    parsed = documents.select(F.from_json(json_col, schema.COMPANYFACTS).alias("d"))
    cik = S.normalize_cik("d.cik")
    rows = parsed.select(
        cik.alias("cik"),
        S.optional_text("d.entityName").alias("entity_name"),
        # both checks sit in what is exploded, so that they hold for empty documents too
        require(cik.isNotNull(), "company facts without a numeric CIK", require(F.col("d.facts").isNotNull(), "company facts without facts", F.col("d.facts"))).alias("facts"),
    )
    if taxonomies is not None:
        rows = rows.withColumn("facts", F.map_filter("facts", lambda k, _: k.isin(list(taxonomies))))
    rows = rows.select("cik", "entity_name", F.explode("facts").alias("taxonomy", "concepts"))
    if concepts is not None:
        rows = rows.withColumn("concepts", F.map_filter("concepts", lambda k, _: k.isin(list(concepts))))
    rows = rows.select("cik", "entity_name", "taxonomy", F.explode("concepts").alias("concept", "c"))
    units = require(F.col("c.units").isNotNull(), "concept without units", F.col("c.units"))
    rows = rows.select("cik", "entity_name", "taxonomy", "concept", "c.label", "c.description", F.size(units).alias("n_units"), F.explode(units).alias("unit", "entries"))
    rows = rows.select(*[c for c in rows.columns if c != "entries"], F.posexplode("entries").alias("pos", "e"))
    rows = rows.select(*[c for c in rows.columns if c != "e"], "e.*")
    # the text of the value, and what kind of JSON it was
    kind = F.lower(F.regexp_extract(F.schema_of_variant("val"), "^[A-Z]+", 0))
    kind = F.when(kind.isin("bigint", "decimal", "double", "float"), "number").when(kind == "void", None).otherwise(kind)
    return rows.withColumn("value_kind", kind).withColumn("val", F.when(~F.is_variant_null("val"), F.coalesce(F.try_variant_get("val", "$", "string"), F.to_json("val"))))


def flag_entries(entries: DataFrame, *, forms: Iterable[str] | None = None) -> DataFrame:
    """Entries to facts with their quality flags.

    Unit ambiguity is judged before the form filter, duplicates after it. NULLs
    are equal in the duplicate key.
    """
    val, start, end, filed = S.optional_text("val"), S.optional_text("start"), S.optional_text("end"), S.optional_text("filed")
    rows = entries.select(
        *(c for c in ("cik", "entity_name", "taxonomy", "concept", "label", "description", "unit", "pos", "n_units", "value_kind") if c in entries.columns),
        F.col("val").alias("value_raw"), S.parse_decimal("val").alias("value"),
        S.parse_date(start).alias("start_date"), S.parse_date(end).alias("end_date"), S.parse_date(filed).alias("filed_date"),
        S.parse_int("fy").alias("fiscal_year"), S.optional_text("fp").alias("fiscal_period"), S.optional_text("form").alias("form"),
        S.optional_text("accn").alias("accession_number"), S.optional_text("frame").alias("frame"),
        ((start.isNotNull() & S.parse_date(start).isNull()) | (end.isNotNull() & S.parse_date(end).isNull()) | (filed.isNotNull() & S.parse_date(filed).isNull())).alias("_bad_date"),
        val.isNull().alias("_no_value"),
    )
    rows = rows.withColumn("period_type", S.period_type("start_date", "end_date"))
    if forms is not None:
        rows = rows.filter(F.upper("form").isin([f.upper() for f in forms]))
    same = F.count("*").over(Window.partitionBy(*(c for c in schema.IDENTITY if c in rows.columns)))
    rules = {
        "missing_value": F.col("_no_value"),
        "non_numeric_value": ~F.col("_no_value") & F.col("value").isNull(),
        "missing_end_date": F.col("end_date").isNull(),
        "inconsistent_period": F.col("start_date") > F.col("end_date"),
        "invalid_date": F.col("_bad_date"),
        "missing_form": F.col("form").isNull(),
        "unsupported_form": ~F.upper("form").isin(list(schema.SUPPORTED_FORMS)),
        "missing_accession_number": F.col("accession_number").isNull(),
        "ambiguous_unit": F.col("n_units") > 1,
        "duplicate_fact": same > 1,
    }
    flags = F.array_compact(F.array(*(F.when(rules[f], F.lit(f)) for f in schema.FLAGS)))
    rows = rows.withColumn("quality_flags", flags).drop("_bad_date", "_no_value", "n_units")
    # each part with its length, so that no two facts share a key; "-" stands for NULL
    part = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
    key = F.concat(*(part(F.col(c).cast("string")) for c in schema.IDENTITY))
    return rows.withColumn("unique_key", key).withColumn("fact_id", F.sha2("unique_key", 256)).withColumn("source", F.lit("companyfacts"))


def normalize_companyfacts(documents: DataFrame, *, taxonomies: Iterable[str] | None = None, concepts: Iterable[str] | None = None, forms: Iterable[str] | None = None) -> DataFrame:
    return flag_entries(flatten_companyfacts(documents, taxonomies=taxonomies, concepts=concepts), forms=forms)


def quality_warnings(facts: DataFrame) -> DataFrame:
    """(flag, n) of the flags that occur."""
    return facts.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
