"""The engine's queries over a folder of tables, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapter
from .adapter import ENTRIES_SQL, ORDERS_SQL, table
from .functions import calendar as C
from .functions import scalars as S
from .operators import analytics, companies, evidence, filings, indicators, inventory, merge, metrics, normalize, periods, retrieval
from .plans.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *, facts: bool = False, orders: bool = False):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ctes = [c for c, wanted in ((ENTRIES_SQL, facts), (ORDERS_SQL, orders)) if wanted]
            body = sql.strip()
            if ctes:
                body = "WITH " + ", ".join(ctes) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
            ORACLES[f.__name__] = body
        return f

    return register


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return normalize.flag_entries(adapter.entries(spark, d))


def _stored_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts as a stored table, for queries that read them more than once; worked out once."""
    return staged(_facts(spark, d).drop("unique_key", "label", "description", "frame", "source", "pos"), "facts")


def _metrics(spark: SparkSession, d: str, facts: DataFrame | None = None) -> DataFrame:
    facts = _stored_facts(spark, d) if facts is None else facts
    return metrics.base_metrics(facts, periods.active_period_keys(facts))


def _money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(28,2)").cast("string")


def _day(c: str) -> Column:
    return F.col(c).cast("string")


# --- flagship ---------------------------------------------------------------------------------------


@query("""
WITH r AS (
  SELECT l_suppkey AS suppkey, CAST(year(l_shipdate) AS INT) AS fiscal_year, CAST(quarter(l_shipdate) AS INT) AS fiscal_quarter,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DECIMAL(28,4)) AS revenue
  FROM lineitem GROUP BY ALL
), a AS (SELECT * FROM r QUALIFY dense_rank() OVER (PARTITION BY suppkey ORDER BY fiscal_year DESC, fiscal_quarter DESC) <= 12
), p AS (
  SELECT *, lag(revenue) OVER w AS before, fiscal_year * 4 + fiscal_quarter - lag(fiscal_year * 4 + fiscal_quarter) OVER w AS step
  FROM a WINDOW w AS (PARTITION BY suppkey ORDER BY fiscal_year, fiscal_quarter)
)
SELECT suppkey, fiscal_year, fiscal_quarter, CAST(revenue AS VARCHAR) AS revenue,
  CASE WHEN step = 1 AND before <> 0 THEN round(CAST(revenue - before AS DOUBLE) / abs(CAST(before AS DOUBLE)), 6) END AS growth,
  CASE WHEN step IS NULL OR step <> 1 THEN 'missing_prior_period' WHEN before = 0 THEN 'zero_prior_period' END AS skip_reason
FROM p""")
def active_quarters_growth(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly revenue of each supplier, its twelve latest quarters, growth on the quarter right before."""
    day = F.col("l_shipdate").cast("date")
    amount = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("suppkey"), F.year(day).alias("fiscal_year"), F.quarter(day).alias("fiscal_quarter"))
    rows = rows.agg(F.sum(amount).cast("decimal(28,4)").alias("revenue"))
    latest = Window.partitionBy("suppkey").orderBy(F.col("fiscal_year").desc(), F.col("fiscal_quarter").desc())
    rows = rows.withColumn("_r", F.dense_rank().over(latest)).filter("_r <= 12")
    w = Window.partitionBy("suppkey").orderBy("fiscal_year", "fiscal_quarter")
    index = F.col("fiscal_year") * 4 + F.col("fiscal_quarter")
    rows = rows.withColumn("_b", F.lag("revenue").over(w)).withColumn("_near", F.coalesce(index - F.lag(index).over(w) == 1, F.lit(False)))
    growth = F.round((F.col("revenue") - F.col("_b")).cast("double") / F.abs(F.col("_b").cast("double")), 6)
    reason = F.when(~F.col("_near"), "missing_prior_period").when(F.col("_b") == 0, "zero_prior_period")
    return rows.select("suppkey", "fiscal_year", "fiscal_quarter", F.col("revenue").cast("string").alias("revenue"), F.when(reason.isNull(), growth).alias("growth"), reason.alias("skip_reason"))


# --- facts ------------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def fact_flatten_json(spark, d):
    return table(spark, d, "events").groupBy("event_type", S.parse_int(F.get_json_object("props", "$.k")).alias("k")).agg(F.count("*").alias("n"))


@query("SELECT cik, concept, fiscal_year, fiscal_period, form, accession_number, CAST(value AS VARCHAR) AS value, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, period_type, flags FROM facts", facts=True)
def quality_flags(spark, d):
    return _facts(spark, d).select("cik", "concept", "fiscal_year", "fiscal_period", "form", "accession_number", _money("value").alias("value"), _day("start_date").alias("start_date"), _day("end_date").alias("end_date"), "period_type", F.array_join("quality_flags", ",").alias("flags"))


@query("SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM facts WHERE flags <> '') GROUP BY flag", facts=True)
def quality_flag_counts(spark, d):
    return normalize.quality_warnings(_facts(spark, d))


@query("SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY text, lang) AS n FROM documents) WHERE n > 1")
def duplicate_facts(spark, d):
    """The duplicate rule over documents: every member of a key group of more than one, NULLs equal."""
    same = Window.partitionBy("key", "lang")
    rows = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("key")).withColumn("n", F.count("*").over(same))
    return rows.filter("n > 1").select("doc_id", "n")


@query("SELECT cik, form, fiscal_year, fiscal_period FROM keys", facts=True)
def active_period_keys(spark, d):
    return periods.active_period_keys(_facts(spark, d))


@query("SELECT DISTINCT f.cik, accession_number FROM facts f JOIN keys USING (cik, form, fiscal_year, fiscal_period) WHERE accession_number IS NOT NULL", facts=True)
def active_accessions(spark, d):
    facts = _stored_facts(spark, d)
    return periods.active_accessions(facts, periods.active_period_keys(facts))


@query("SELECT cik, accession_number, statement_type, metric_name, CAST(value AS VARCHAR) AS value, fiscal_year, fiscal_period, is_active FROM metrics", facts=True)
def base_metric_mapping(spark, d):
    return _metrics(spark, d).select("cik", "accession_number", "statement_type", "metric_name", _money("value").alias("value"), "fiscal_year", "fiscal_period", F.col("is_active_window").alias("is_active"))


_TRACE_SQL = """
fact_keys AS (
  SELECT DISTINCT concat_ws('|', cik, concept, fiscal_year, fiscal_period, coalesce(accession_number, '-'), coalesce(CAST(end_date AS VARCHAR), '-')) AS k, taxonomy, concept, value_raw FROM facts
), stored AS (SELECT accession_number, max(form) AS form_type, max(filed_date) AS filed_on FROM facts WHERE accession_number IS NOT NULL GROUP BY 1
), traced AS (
  SELECT m.cik, m.statement_type, m.metric_name, m.fiscal_year, m.fiscal_period, m.accession_number, f.concept, f.value_raw, g.form_type, CAST(g.filed_on AS VARCHAR) AS filed_on
  FROM metrics m LEFT JOIN fact_keys f ON f.k = concat_ws('|', m.cik, m.concept, m.fiscal_year, m.fiscal_period, coalesce(m.accession_number, '-'), coalesce(CAST(m.end_date AS VARCHAR), '-'))
  LEFT JOIN stored g ON g.accession_number = m.accession_number
)"""


def _traced(spark, d, join):
    facts = _stored_facts(spark, d)
    stored = facts.filter("accession_number is not null").groupBy("accession_number").agg(F.max(F.col("form")).alias("form_type"), F.max("filed_date").alias("filing_date"), F.lit(None).cast("string").alias("document_url"))
    rows = join(_metrics(spark, d, facts), facts.dropDuplicates(["fact_id"]), stored)
    return rows.select("cik", "statement_type", "metric_name", "fiscal_year", "fiscal_period", "accession_number", "concept", F.col("fact_value_raw").alias("value_raw"), "form_type", _day("filed_on").alias("filed_on"))


@query(f"WITH {_TRACE_SQL} SELECT * FROM traced", facts=True)
def traceability(spark, d):
    return _traced(spark, d, metrics.trace)


@query(f"WITH {_TRACE_SQL} SELECT * FROM traced WHERE cik = '0000000001' ORDER BY statement_type, metric_name, fiscal_year DESC, fiscal_period DESC, accession_number DESC LIMIT 8", facts=True)
def trace_sample(spark, d):
    """The first eight traced metrics of a company."""
    return _traced(spark, d, lambda m, f, g: metrics.trace_sample(m.filter("cik = '0000000001'"), f, g))


@query("""
SELECT cik, accession_number, form, fiscal_year, fiscal_period, CAST(max(end_date) AS VARCHAR) AS report_date
FROM facts WHERE accession_number IS NOT NULL AND form IS NOT NULL GROUP BY ALL""", facts=True)
def filing_period_summary(spark, d):
    """Each adapter filing has one period."""
    return filings.period_summary(_facts(spark, d)).withColumn("report_date", _day("report_date"))


# --- filings ------------------------------------------------------------------------------------------


@query("SELECT cik, form_type, accession_number, CAST(filing_date AS VARCHAR) AS filing_date FROM filings QUALIFY row_number() OVER (PARTITION BY cik, form_type ORDER BY filing_date DESC, pos) = 1", orders=True)
def latest_per_form(spark, d):
    return filings.latest_per_form(adapter.order_filings(spark, d)).select("cik", "form_type", "accession_number", _day("filing_date").alias("filing_date"))


@query("SELECT cik, form_type, accession_number FROM filings QUALIFY row_number() OVER (PARTITION BY cik, form_type ORDER BY pos) = 1", orders=True)
def first_seen_per_form(spark, d):
    return filings.latest_per_form(adapter.order_filings(spark, d), first_seen=True).select("cik", "form_type", "accession_number")


def _accessions(spark, d):
    return adapter.order_filings(spark, d).filter("pos % 10 = 3").select("cik", "accession_number")


@query("""
SELECT f.cik, accession_number, form_type FROM filings f JOIN accessions USING (cik, accession_number)
UNION ALL
SELECT cik, accession_number, form_type FROM (SELECT * FROM filings WHERE cik NOT IN (SELECT cik FROM accessions))
QUALIFY row_number() OVER (PARTITION BY cik, form_type ORDER BY filing_date DESC, pos) = 1""", orders=True)
def active_filing_selection(spark, d):
    return filings.select_active(adapter.order_filings(spark, d), _accessions(spark, d)).select("cik", "accession_number", "form_type")


@query("""
SELECT cik, count(*) AS n, CASE WHEN count(*) > 5 THEN array_to_string(list_sort(list(accession_number))[1:5], ', ') || ' (+' || (count(*) - 5) || ' more)'
  ELSE array_to_string(list_sort(list(accession_number)), ', ') END AS message
FROM filings WHERE form_type <> '10-K' GROUP BY cik""", orders=True)
def missing_accessions(spark, d):
    """Accessions that a list of 10-K filings doesn't hold."""
    rows = adapter.order_filings(spark, d)
    return filings.describe_missing(filings.missing_accessions(rows.filter("form_type = '10-K'"), rows.select("cik", "accession_number")))


@query("SELECT cik, accession_number FROM filings WHERE pos % 10 <> 3", orders=True)
def new_accessions(spark, d):
    return filings.new_accessions(adapter.order_filings(spark, d), _accessions(spark, d))


@query("SELECT accession_number, pos % 10 = 3 AS is_active FROM filings", orders=True)
def set_active_flags(spark, d):
    rows = adapter.order_filings(spark, d).withColumn("is_active_window", F.lit(True))
    return filings.set_active(rows, _accessions(spark, d)).select("accession_number", F.col("is_active_window").alias("is_active"))


@query("SELECT form_type, count(*) FILTER (pos % 10 = 3) AS n_active FROM filings WHERE form_type <> '8-K' GROUP BY 1", orders=True)
def filings_by_form(spark, d):
    rows = adapter.order_filings(spark, d).withColumn("is_active_window", F.col("pos") % 10 == 3)
    return inventory.filings_by_form(rows)


@query("SELECT cik, form_type, CAST(row_number() OVER (PARTITION BY cik, form_type ORDER BY filing_date DESC, accession_number DESC) AS INT) AS place, accession_number FROM filings WHERE form_type <> '8-K'", orders=True)
def accessions_per_form(spark, d):
    return inventory.accessions_per_form(adapter.order_filings(spark, d))


# --- calendar -----------------------------------------------------------------------------------------

_CALENDAR_SQL = """
years AS (SELECT CAST(y AS INT) AS y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(1990, 2031) t(y)),
e1 AS (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM years),
e2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e1),
e3 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS s FROM e2),
days AS (SELECT CAST(g AS DATE) AS day, year(g) AS y, month(g) AS m, day(g) AS dd, isodow(g) AS w FROM generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY) t(g)),
fixed AS (SELECT day + CASE w WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END AS day FROM days WHERE (m, dd) IN ((1, 1), (7, 4), (12, 25)) OR (m = 6 AND dd = 19 AND y >= 2022)),
closed AS (
  SELECT day FROM fixed UNION SELECT make_date(y, CAST(s // 31 AS INT), CAST(s % 31 + 1 AS INT)) - 2 FROM e3
  UNION SELECT day FROM days WHERE w = 1 AND ((m IN (1, 2) AND dd BETWEEN 15 AND 21) OR (m = 5 AND dd >= 25) OR (m = 9 AND dd <= 7)) UNION SELECT day FROM days WHERE w = 4 AND m = 11 AND dd BETWEEN 22 AND 28
), open AS (SELECT day FROM days WHERE w < 6 AND day NOT IN (SELECT day FROM closed))"""


@query(f"""
WITH {_CALENDAR_SQL}, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT d, day AS prev FROM o ASOF JOIN open ON d >= day), n AS (SELECT d, day AS next FROM o ASOF JOIN open ON d <= day)
SELECT CAST(d AS VARCHAR) AS d, prev = d AS is_business_day, CAST(prev AS VARCHAR) AS previous_day, CAST(next AS VARCHAR) AS next_day FROM p JOIN n USING (d)""")
def business_calendar(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    day = F.col("d")
    return rows.select(_day("d").alias("d"), C.is_business_day(day).alias("is_business_day"), C.previous_business_day(day).cast("string").alias("previous_day"), C.next_business_day(day).cast("string").alias("next_day"))


@query(f"""
WITH {_CALENDAR_SQL}, due AS (
  SELECT pos, form_type, CASE form_type WHEN '10-K' THEN CAST(filing_date + INTERVAL 12 MONTH AS DATE) WHEN '10-Q' THEN CAST(filing_date + CASE WHEN quarter(filing_date) = 3 THEN INTERVAL 6 MONTH ELSE INTERVAL 3 MONTH END AS DATE) END AS d
  FROM filings WHERE form_type <> '8-K')
SELECT pos, form_type, CAST(day AS VARCHAR) AS next_check FROM due ASOF JOIN open ON d >= day""", orders=True)
def next_check_dates(spark, d):
    fp = F.concat(F.lit("Q"), F.quarter("filing_date"))
    rows = adapter.order_filings(spark, d).filter("form_type <> '8-K'").select("pos", "form_type", C.due_date(F.col("form_type"), F.col("filing_date"), fp).alias("due"))
    return C.attach_business_day(rows, "due", "next_check").select("pos", "form_type", _day("next_check").alias("next_check"))


@query("""
WITH n AS (SELECT cik, max(filing_date) FILTER (form_type = '10-K') AS k, max(filing_date) FILTER (form_type = '10-Q') AS q FROM filings GROUP BY cik)
SELECT cik, coalesce(DATE '2000-06-30' >= k, true) AS due_10k, coalesce(DATE '2000-06-30' >= q, true) AS due_10q, coalesce(DATE '2000-06-30' >= k, true) OR coalesce(DATE '2000-06-30' >= q, true) AS due FROM n""", orders=True)
def refresh_due(spark, d):
    of = lambda form: F.max(F.when(F.col("form_type") == form, F.col("filing_date")))
    rows = adapter.order_filings(spark, d).groupBy("cik").agg(of("10-K").alias("next_check_date_10k"), of("10-Q").alias("next_check_date_10q"))
    return companies.due_companies(rows, "2000-06-30")


# --- merges -------------------------------------------------------------------------------------------


def _batch(spark, d):
    """Changes to customers: some known, some new, some twice."""
    rows = table(spark, d, "customer").filter("c_custkey % 3 = 0")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1_000_000)
    rows = rows.select(key.alias("c_custkey"), F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return rows.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("c_name", F.concat("c_name", F.col("seq").cast("string")))


_BATCH_SQL = """
batch AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS c_custkey, upper(c_name) || '2' AS c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)"""


@query(f"""
WITH {_BATCH_SQL}
SELECT coalesce(b.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN c.c_name ELSE b.c_name END AS c_name,
  CASE WHEN c.c_custkey IS NULL THEN b.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment FROM customer c FULL JOIN batch b ON b.c_custkey = c.c_custkey""")
def upsert_last_wins(spark, d):
    """The batch's last row of a key wins; the segment of the first insert is kept."""
    existing = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return merge.upsert(existing, _batch(spark, d), ["c_custkey"], order="seq", keep_first=["c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


@query(f"WITH {_BATCH_SQL} SELECT c.c_custkey, c.c_name, coalesce(b.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'X' || c_mktsegment END AS c_mktsegment FROM batch) b USING (c_custkey)")
def partial_update(spark, d):
    existing = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("X"), "c_mktsegment"))
    return merge.partial_update(existing, _batch(spark, d).filter("seq = 2").withColumn("c_mktsegment", changed), ["c_custkey"], ["c_mktsegment"])


@query("""
SELECT 'facts' AS table_name, count(*) FILTER (CAST(cik AS BIGINT) % 4 = 0) AS n_deleted, count(*) FILTER (CAST(cik AS BIGINT) % 4 <> 0) AS n_left FROM facts
UNION ALL SELECT 'metrics', count(*) FILTER (CAST(cik AS BIGINT) % 4 = 0), count(*) FILTER (CAST(cik AS BIGINT) % 4 <> 0) FROM metrics""", facts=True)
def cascade_delete(spark, d):
    facts = _stored_facts(spark, d)
    made = staged(_metrics(spark, d, facts), "metrics")
    gone = facts.select("cik").distinct().filter(F.col("cik").cast("long") % 4 == 0)
    left, counts = merge.cascade_delete({"facts": facts, "metrics": made}, gone)
    return counts.join(inventory.table_counts(left).withColumnRenamed("n_rows", "n_left"), "table_name")


# --- inventories --------------------------------------------------------------------------------------


@query("SELECT 'facts' AS table_name, count(*) AS n_rows FROM facts UNION ALL SELECT 'metrics', count(*) FROM metrics UNION ALL SELECT 'documents', count(*) FROM documents", facts=True)
def table_counts(spark, d):
    return inventory.table_counts({"facts": (facts := _stored_facts(spark, d)), "metrics": _metrics(spark, d, facts), "documents": table(spark, d, "documents")})


@query("""
SELECT 'customer' AS table_name, count(*) FILTER (c_custkey % 2 = 0) AS n_before, count(*) AS n_after, count(*) FILTER (c_custkey % 2 = 1) AS delta FROM customer
UNION ALL SELECT 'part', 0, count(*), count(*) FROM part""")
def count_deltas(spark, d):
    customer = table(spark, d, "customer")
    return inventory.count_deltas(inventory.table_counts({"customer": customer.filter("c_custkey % 2 = 0")}), inventory.table_counts({"customer": customer, "part": table(spark, d, "part")}))


@query("SELECT statement_type, count(*) AS n_metrics, count(*) FILTER (is_active) AS n_active FROM metrics GROUP BY 1", facts=True)
def metric_counts_by_statement(spark, d):
    return inventory.metrics_by_statement(_metrics(spark, d))


@query("SELECT cik, metric_name, count(DISTINCT fiscal_year) FILTER (fiscal_period = 'FY') AS n_annual, count(DISTINCT fiscal_year || fiscal_period) FILTER (fiscal_period <> 'FY') AS n_quarterly FROM metrics GROUP BY ALL", facts=True)
def metric_coverage(spark, d):
    return inventory.metric_coverage(_metrics(spark, d))


_LABEL_SQL = "'FY' || fiscal_year || CASE fiscal_period WHEN 'FY' THEN '' ELSE ' ' || fiscal_period END"


@query(f"""
SELECT taxonomy, concept, count(*) AS n_facts, 'USD' AS units, array_to_string(list_sort(list_distinct(list(form) FILTER (form IS NOT NULL))), ',') AS forms, count(DISTINCT {_LABEL_SQL}) AS n_periods,
  CASE WHEN concept IN ('Assets','AssetsCurrent','Liabilities','LiabilitiesCurrent') THEN 'Balance sheet' WHEN concept LIKE 'NetCash%' OR concept LIKE 'Payments%' THEN 'Cash flow statement' ELSE 'Income statement' END AS section
FROM facts GROUP BY taxonomy, concept""", facts=True)
def concept_inventory(spark, d):
    rows = inventory.concept_inventory(_facts(spark, d))
    return rows.select("taxonomy", "concept", "n_facts", F.array_join("units", ",").alias("units"), F.array_join("forms", ",").alias("forms"), F.size("periods").cast("long").alias("n_periods"), "section")


@query("""
SELECT CASE WHEN concept IN ('Assets','AssetsCurrent','Liabilities','LiabilitiesCurrent') THEN 'Balance sheet' WHEN concept LIKE 'NetCash%' OR concept LIKE 'Payments%' THEN 'Cash flow statement' ELSE 'Income statement' END AS section,
  count(DISTINCT concept) AS n_concepts, count(*) AS n_facts FROM facts GROUP BY 1""", facts=True)
def statement_sections(spark, d):
    return inventory.statement_sections(_facts(spark, d))


@query(f"SELECT statement_type, metric_name, count(*) AS n_values, array_to_string(list_sort(list_distinct(list({_LABEL_SQL}))), ', ') AS periods FROM metrics GROUP BY ALL", facts=True)
def metric_report(spark, d):
    return inventory.metric_report(_metrics(spark, d)).select("statement_type", "metric_name", "n_values", F.array_join("periods", ", ").alias("periods"))


@query(f"""
SELECT form, count(*) AS n_periods, array_to_string(list(label ORDER BY fiscal_year DESC, fiscal_period = 'FY' DESC, fiscal_period DESC), ', ') AS periods
FROM (SELECT DISTINCT form, fiscal_year, fiscal_period, {_LABEL_SQL} AS label FROM facts) GROUP BY form""", facts=True)
def period_coverage(spark, d):
    return inventory.period_coverage(_facts(spark, d)).select("form", "n_periods", F.array_join("periods", ", ").alias("periods"))


@query("SELECT accession_number, form AS form_type, concept, count(*) AS n_facts FROM facts WHERE accession_number IS NOT NULL AND form IS NOT NULL GROUP BY ALL", facts=True)
def filing_facts(spark, d):
    facts = _facts(spark, d).filter("accession_number is not null and form is not null")
    listed = facts.select("accession_number", F.col("form").alias("form_type")).distinct()
    return inventory.filing_facts(listed, facts).select("accession_number", "form_type", "concept", "n_facts")


# --- indicators and analytics -------------------------------------------------------------------------

_INDICATORS_SQL = """
active AS (SELECT * FROM metrics WHERE is_active),
wide AS (
  SELECT cik, fiscal_year, fiscal_period, max(value) FILTER (metric_name = 'revenue') AS revenue, max(value) FILTER (metric_name = 'gross_profit') AS gross, max(value) FILTER (metric_name = 'operating_income') AS op,
    max(value) FILTER (metric_name = 'net_income') AS net, max(value) FILTER (metric_name = 'total_assets') AS assets, max(value) FILTER (metric_name = 'total_liabilities') AS liab, max(value) FILTER (metric_name = 'current_assets') AS ca,
    max(value) FILTER (metric_name = 'current_liabilities') AS cl, max(value) FILTER (metric_name = 'operating_cash_flow') AS ocf, max(value) FILTER (metric_name = 'capital_expenditure') AS capex,
    max(period_type) FILTER (metric_name = 'total_assets') AS assets_kind, CASE fiscal_period WHEN 'FY' THEN fiscal_year ELSE fiscal_year * 4 + CAST(fiscal_period[2] AS INT) END AS i
  FROM active GROUP BY cik, fiscal_year, fiscal_period
), prior AS (
  SELECT w.*, CASE WHEN lag(i) OVER p = i - 1 THEN lag(revenue) OVER p END AS before FROM wide w WINDOW p AS (PARTITION BY cik, fiscal_period = 'FY' ORDER BY i)
), unrolled AS (
  SELECT cik, fiscal_year, fiscal_period, unnest(['revenue_growth','gross_margin','operating_margin','net_margin','debt_ratio','current_ratio','free_cash_flow','cash_conversion']) AS indicator_name,
    unnest([revenue - before, gross, op, net, liab, ca, ocf, ocf]) AS a, unnest([before, revenue, revenue, revenue, assets, cl, capex, net]) AS b,
    unnest([revenue IS NULL, false, false, false, false, false, false, false]) AS no_top, unnest([false, false, false, false, assets_kind = 'unknown', false, false, false]) AS wrong_kind
  FROM prior
), judged AS (
  SELECT *, CASE WHEN indicator_name = 'revenue_growth' AND no_top THEN 'missing_required_metric' WHEN indicator_name = 'revenue_growth' AND b IS NULL THEN 'missing_prior_period'
      WHEN a IS NULL OR b IS NULL THEN 'missing_required_metric' WHEN wrong_kind THEN 'period_type_mismatch'
      WHEN b = 0 AND indicator_name = 'revenue_growth' THEN 'zero_prior_period' WHEN b = 0 AND indicator_name <> 'free_cash_flow' THEN 'zero_denominator' END AS skip_reason
  FROM unrolled
), indicators AS (
  SELECT *, CASE WHEN skip_reason IS NOT NULL THEN NULL WHEN indicator_name = 'free_cash_flow' THEN CAST(a - abs(b) AS DECIMAL(28,6))
      ELSE CAST(round(CAST(a AS DOUBLE) / CAST(CASE indicator_name WHEN 'revenue_growth' THEN abs(b) ELSE b END AS DOUBLE), 6) AS DECIMAL(28,6)) END AS value
  FROM judged
)"""


def _six(c: str) -> Column:
    return F.col(c).cast("decimal(28,6)").cast("string")


@query(f"WITH {_INDICATORS_SQL} SELECT cik, fiscal_year, fiscal_period, indicator_name, CAST(value AS VARCHAR) AS value, skip_reason FROM indicators", facts=True)
def indicators_long(spark, d):
    return indicators.calculate(_metrics(spark, d)).select("cik", "fiscal_year", "fiscal_period", "indicator_name", _six("value").alias("value"), "skip_reason")


@query(f"WITH {_INDICATORS_SQL} SELECT indicator_name, CASE fiscal_period WHEN 'FY' THEN 'annual' ELSE 'quarterly' END AS period_kind, 'v1' AS formula_version, count(*) FILTER (skip_reason IS NULL) AS n_calculated, count(*) FILTER (skip_reason IS NOT NULL) AS n_skipped FROM indicators GROUP BY ALL", facts=True)
def indicator_summary(spark, d):
    return indicators.summary(indicators.calculate(_metrics(spark, d)))


@query(f"""
WITH {_INDICATORS_SQL}, m AS (SELECT cik, fiscal_year, fiscal_period, max(value) FILTER (indicator_name = 'gross_margin') AS g, max(value) FILTER (indicator_name = 'operating_margin') AS o, max(value) FILTER (indicator_name = 'net_margin') AS n FROM indicators GROUP BY ALL)
SELECT cik, fiscal_year, fiscal_period, CAST(g - o AS VARCHAR) AS operating_cost_share, CAST(o - n AS VARCHAR) AS below_operating_share FROM m""", facts=True)
def margin_steps(spark, d):
    rows = analytics.margin_steps(indicators.calculate(_metrics(spark, d)))
    return rows.select("cik", "fiscal_year", "fiscal_period", _six("operating_cost_share").alias("operating_cost_share"), _six("below_operating_share").alias("below_operating_share"))


_SERIES_SQL = """
series AS (SELECT cik, metric_name AS series, fiscal_year, fiscal_period, value, CASE fiscal_period WHEN 'FY' THEN 'annual' ELSE 'quarterly' END AS kind,
  CASE fiscal_period WHEN 'FY' THEN fiscal_year ELSE fiscal_year * 4 + CAST(fiscal_period[2] AS INT) END AS i FROM metrics WHERE is_active),
steps AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 THEN lag(value) OVER w END AS prior, i - lag(i) OVER w - 1 AS n_missing FROM series WINDOW w AS (PARTITION BY cik, series, kind ORDER BY i))"""


def _series(spark, d):
    return analytics.metric_series(_metrics(spark, d))


@query(f"WITH {_SERIES_SQL} SELECT cik, series, {_LABEL_SQL} AS period, CAST(value AS VARCHAR) AS value FROM series", facts=True)
def chart_ready(spark, d):
    return analytics.chart_rows(_series(spark, d)).withColumn("value", _money("value"))


@query(f"""WITH {_SERIES_SQL} SELECT cik, series, kind, fiscal_year, fiscal_period, CAST(value AS VARCHAR) AS value, CAST(prior AS VARCHAR) AS prior_value, CAST(value - prior AS VARCHAR) AS absolute_change,
  CASE WHEN prior <> 0 THEN round(CAST(value - prior AS DOUBLE) / CAST(abs(prior) AS DOUBLE), 6) END AS percent_change FROM steps""", facts=True)
def period_comparison(spark, d):
    rows = analytics.compare_periods(_series(spark, d))
    for c in ("value", "prior_value", "absolute_change"):
        rows = rows.withColumn(c, _money(c))
    return rows


@query(f"""WITH {_SERIES_SQL} SELECT cik, series, kind, count(*) AS n_periods, CASE WHEN count(*) < 2 THEN 'single_period' WHEN arg_max(value, i) > arg_min(value, i) THEN 'up' WHEN arg_max(value, i) < arg_min(value, i) THEN 'down' ELSE 'flat' END AS direction,
  CAST(arg_max(value, i) AS VARCHAR) AS latest_value, CAST(arg_max({{'x': value - prior}}, i).x AS VARCHAR) AS change_from_prior FROM steps GROUP BY cik, series, kind""", facts=True)
def trend_summary(spark, d):
    rows = analytics.trends(_series(spark, d))
    return rows.select("cik", "series", "kind", "n_periods", "direction", _money("latest_value").alias("latest_value"), _money("change_from_prior").alias("change_from_prior"))


@query(f"WITH {_SERIES_SQL} SELECT cik, series, kind, fiscal_year, fiscal_period, n_missing FROM steps WHERE n_missing > 0", facts=True)
def gap_notes(spark, d):
    return analytics.gaps(_series(spark, d))


@query(f"""WITH {_SERIES_SQL}, z AS (SELECT *, round((CAST(value AS DOUBLE) - avg(CAST(value AS DOUBLE)) OVER w) / nullif(stddev_pop(CAST(value AS DOUBLE)) OVER w, 0), 6) AS z FROM series WINDOW w AS (PARTITION BY cik, series, kind))
SELECT cik, series, kind, fiscal_year, fiscal_period, round(z, 4) AS z FROM z WHERE abs(z.z) > 2""", facts=True)
def outlier_notes(spark, d):
    return analytics.outliers(_series(spark, d)).select("cik", "series", "kind", "fiscal_year", "fiscal_period", F.round("z", 4).alias("z"))


@query(f"""WITH {_SERIES_SQL}, b AS (SELECT series, fiscal_year, fiscal_period, avg(CAST(value AS DOUBLE)) AS b FROM series WHERE series IN ('revenue', 'total_assets') AND fiscal_period = 'FY' AND fiscal_year % 2 = 0 GROUP BY ALL)
SELECT cik, series, CASE WHEN count(b) = 0 THEN 'refused' ELSE 'compared' END AS benchmark_status, CASE WHEN count(b) = 0 THEN 'no benchmark data' END AS reason, count(b) AS n_compared, count(*) FILTER (CAST(value AS DOUBLE) > b) AS n_above
FROM series LEFT JOIN b USING (series, fiscal_year, fiscal_period) GROUP BY cik, series""", facts=True)
def benchmark_status(spark, d):
    """Two series have a benchmark in some years, the mean of all companies; the others are refused."""
    rows = staged(_series(spark, d).withColumn("value", F.col("value").cast("double")), "series")
    benchmark = rows.filter("series in ('revenue', 'total_assets') and fiscal_period = 'FY' and fiscal_year % 2 = 0").drop("cik")
    return analytics.benchmark_status(rows, benchmark)


# --- retrieval ----------------------------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_sha256 FROM t""")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(retrieval.html_text(F.col("html")), 256).alias("text_sha256"))


@query("SELECT doc_id AS id, lang, CAST(n AS INT) AS chunk_no, sha256(substr(text, n * 512 + 1, 512)) AS chunk_sha256 FROM documents, range(CAST(ceil(length(text) / 512.0) AS BIGINT)) t(n)")
def chunk_documents(spark, d):
    rows = retrieval.chunk(table(spark, d, "documents").select("doc_id", "text", "lang"), id_col="doc_id", text_col="text")
    return rows.select("id", "lang", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha256"))


@query("SELECT doc_id AS id, CAST(ceil(length(text) / 512.0) AS BIGINT) AS n_chunks, CAST(length(text) AS BIGINT) AS n_chars, CAST(least(512, length(text)) AS BIGINT) AS longest FROM documents WHERE length(text) > 0")
def chunk_summary(spark, d):
    return retrieval.chunk_summary(retrieval.chunk(table(spark, d, "documents").select("doc_id", "text"), id_col="doc_id", text_col="text"))


@query(r"""
WITH qt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM p GROUP BY term),
s AS (SELECT item_id AS query_id, doc_id AS id, round(sum((1 + ln(tf)) * idf * qtf), 6) AS score FROM p JOIN i USING (term) JOIN q USING (term) GROUP BY ALL)
SELECT query_id, id, round(score, 4) AS score FROM s QUALIFY rank() OVER (PARTITION BY query_id ORDER BY s.score DESC, id) <= 5""")
def lexical_topk(spark, d):
    rows = retrieval.lexical_topk(table(spark, d, "documents"), table(spark, d, "benchmark"), id_col="doc_id", text_col="text", query_id="item_id", query_text="text")
    return rows.select("query_id", "id", F.round("score", 4).alias("score"))


@query("""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0)
SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity([CAST(x AS DOUBLE) FOR x IN e.embedding], [CAST(x AS DOUBLE) FOR x IN q.embedding]), 6) AS score FROM q JOIN embeddings e ON q.vec_id <> e.vec_id
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def vector_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return retrieval.vector_topk(rows, rows.filter("vec_id % 20 = 0"), id_col="vec_id", vector_col="embedding").select("query_id", "id", "score")


@query(f"WITH {_INDICATORS_SQL} SELECT 'documents' AS evidence_type, count(*) AS n_items, count(*) = 0 AS is_missing FROM documents UNION ALL SELECT 'pages', count(*), count(*) = 0 FROM pages UNION ALL SELECT 'metrics', count(*), count(*) = 0 FROM metrics UNION ALL SELECT 'indicators', count(*), count(*) = 0 FROM indicators WHERE skip_reason IS NULL UNION ALL SELECT 'answers', count(*), count(*) = 0 FROM conversations WHERE role = 'nobody'", facts=True)
def evidence_inventory(spark, d):
    made = staged(_metrics(spark, d), "metrics")
    answers = table(spark, d, "conversations").filter("role = 'nobody'")
    return evidence.inventory({"documents": table(spark, d, "documents"), "pages": table(spark, d, "pages"), "metrics": made, "indicators": indicators.calculate(made).filter("skip_reason is null"), "answers": answers})


@query("""
WITH c AS (SELECT conv_id AS claim_id, count(*) AS n_cited, count(d.doc_id) AS n_found FROM conversations c LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON c.conv_id * 7 + c.turn = d.doc_id WHERE role = 'assistant' GROUP BY 1)
SELECT claim_id, n_cited, n_found, n_cited = n_found AS is_supported FROM c""")
def unsupported_claims(spark, d):
    """Answers cite documents by number; some don't exist."""
    cited = table(spark, d, "conversations").filter("role = 'assistant'").groupBy(F.col("conv_id").alias("claim_id")).agg(F.collect_list(F.col("conv_id") * 7 + F.col("turn")).alias("evidence_ids"))
    return evidence.unsupported_claims(cited, table(spark, d, "documents").select(F.col("doc_id").alias("evidence_id")))


from . import catalog_documents  # noqa: E402, F401  registers further queries
