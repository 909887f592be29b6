"""More queries: source documents made from the tables and read back, rows of the repositories, listings, reports, texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import adapter, catalog
from .adapter import table
from .catalog import _CALENDAR_SQL, _INDICATORS_SQL, _LABEL_SQL, _day, _facts, _metrics, _money, _stored_facts, query
from .functions import scalars as S
from .operators import companies, evidence, filings, indicators, inventory, merge, metrics, normalize, retrieval
from .plans import report
from .plans.staging import folder, staged
from .sources.tables import KeyedTable

# --- documents as the source has them -------------------------------------------------------------------


def _ticker_documents(spark, d) -> DataFrame:
    """A document of tickers for each nation, with blanks, lower case and tickers that come twice."""
    entry = F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit(" s"), F.col("s_suppkey") % 7, F.lit("x"), "s_nationkey").alias("ticker"), F.col("s_name").alias("title"))
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), entry)))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(pairs).alias("json"))


_TICKERS_SQL = """
SELECT 'S' || (s_suppkey % 7) || 'X' || s_nationkey AS ticker, lpad(CAST(max(s_suppkey) AS VARCHAR), 10, '0') AS cik, arg_max(s_name, s_suppkey) AS title FROM supplier GROUP BY s_suppkey % 7, s_nationkey"""


@query(_TICKERS_SQL)
def ticker_map(spark, d):
    return normalize.ticker_map(_ticker_documents(spark, d))


@query(f"""
WITH t AS ({_TICKERS_SQL}), asked AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_custkey ELSE ' s' || (c_custkey % 9) || 'x' || c_nationkey END AS identifier FROM customer)
SELECT DISTINCT identifier, cik, title AS name FROM asked LEFT JOIN t ON CASE WHEN regexp_full_match(trim(identifier), '[0-9]+') THEN cik = lpad(trim(identifier), 10, '0') ELSE ticker = upper(trim(identifier)) END
QUALIFY row_number() OVER (PARTITION BY identifier ORDER BY cik) = 1""")
def ticker_lookup(spark, d):
    """Companies by ticker in any case or by number."""
    known = normalize.ticker_map(_ticker_documents(spark, d)).select("cik", F.col("title").alias("name"), "ticker")
    key = F.col("c_custkey")
    asked = table(spark, d, "customer").select(F.when(key % 2 == 0, F.concat(F.lit(" "), key)).otherwise(F.concat(F.lit(" s"), key % 9, F.lit("x"), "c_nationkey")).alias("identifier"))
    return companies.lookup(known, asked)


def _submissions(spark, d) -> DataFrame:
    """A document for each customer that ordered: its orders as parallel arrays of recent filings."""
    o = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(o.alias("o"))
    form = lambda x: F.when(x["o_orderstatus"] == "F", " 10-k").when(x["o_orderstatus"] == "O", "10-Q").otherwise("8-K")
    each = lambda f: F.transform("o", f)
    recent = F.struct(
        each(lambda x: F.format_string("%012d-24", x["o_orderkey"])).alias("accessionNumber"), each(lambda x: x["day"]).alias("filingDate"),
        each(form).alias("form"), each(lambda x: F.concat(F.lit("d"), x["o_orderkey"], F.lit(".htm"))).alias("primaryDocument"),
    )
    tickers = F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c"), "o_custkey"), F.lit("other")))
    name = F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit(" Customer "), "o_custkey"))
    document = F.struct(F.col("o_custkey").cast("string").alias("cik"), name.alias("name"), tickers.alias("tickers"), F.array(F.lit("NYSE")).alias("exchanges"), F.lit("").alias("sic"), F.struct(recent.alias("recent")).alias("filings"))
    return rows.select(F.to_json(document).alias("json"))


@query("""
SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '-24' AS accession_number, CASE o_orderstatus WHEN 'F' THEN '10-K' ELSE '10-Q' END AS form_type,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '24/d' || o_orderkey || '.htm' AS document_url
FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def recent_filings(spark, d):
    return normalize.recent_filings(_submissions(spark, d)).select("cik", "accession_number", "form_type", _day("filing_date").alias("filing_date"), "document_url")


@query("""
SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN o_custkey % 5 <> 0 THEN 'Customer ' || o_custkey END AS name, CASE WHEN o_custkey % 3 <> 0 THEN 'C' || o_custkey END AS ticker, 'NYSE' AS exchange, CAST(NULL AS VARCHAR) AS sic FROM orders""")
def company_profiles(spark, d):
    return companies.company_profile(_submissions(spark, d)).select("cik", "name", "ticker", "exchange", "sic")


def _fact_documents(spark, d) -> DataFrame:
    """A document for each supplier: revenue as numbers, quantities of another taxonomy as texts, by year."""
    year = F.year("l_shipdate")
    sums = table(spark, d, "lineitem").groupBy("l_suppkey", year.alias("fy")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    sums = sums.withColumn("form", F.when(F.col("fy") % 2 == 0, "10-k").otherwise("8-K")).withColumn("accn", F.format_string("%d-%d", "l_suppkey", "fy"))
    rows = sums.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("fy", "v", "q", "form", "accn"))).alias("r"))
    entry = lambda val: F.transform("r", lambda x: F.struct(val(x).alias("val"), F.concat(x["fy"], F.lit("-12-31")).alias("end"), x["fy"].alias("fy"), F.lit("FY").alias("fp"), x["form"].alias("form"), x["accn"].alias("accn")))
    concept = lambda unit, entries: F.struct(F.create_map(F.lit(unit), entries).alias("units"))
    facts = F.struct(
        F.create_map(F.lit("Revenues"), concept("USD", entry(lambda x: x["v"].cast("decimal(38,2)")))).alias("us-gaap"), F.create_map(F.lit("Quantity"), concept("pure", entry(lambda x: x["q"].cast("string")))).alias("dei")
    )
    return rows.select(F.to_json(F.struct(F.col("l_suppkey").alias("cik"), F.concat(F.lit("Supplier "), "l_suppkey").alias("entityName"), facts.alias("facts"))).alias("json"))


_FACT_DOCUMENTS_SQL = """
s AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS fy, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q FROM lineitem GROUP BY ALL)"""


@query(f"""
WITH {_FACT_DOCUMENTS_SQL}
SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik, 'Supplier ' || l_suppkey AS entity_name, t.taxonomy, t.concept, t.unit, fy AS fiscal_year, CASE WHEN fy % 2 = 0 THEN '10-k' ELSE '8-K' END AS form,
  CAST(CAST(CASE t.concept WHEN 'Revenues' THEN v ELSE q END AS DECIMAL(28,2)) AS VARCHAR) AS value, t.kind AS value_kind, l_suppkey || '-' || fy AS accession_number, CASE WHEN fy % 2 = 0 THEN '' ELSE 'unsupported_form' END AS flags
FROM s, (VALUES ('us-gaap', 'Revenues', 'USD', 'number'), ('dei', 'Quantity', 'pure', 'string')) t(taxonomy, concept, unit, kind)""")
def companyfacts_scan(spark, d):
    """Four levels of a document to typed facts; the kind of JSON value is kept."""
    rows = normalize.normalize_companyfacts(_fact_documents(spark, d))
    return rows.select("cik", "entity_name", "taxonomy", "concept", "unit", "fiscal_year", "form", _money("value").alias("value"), "value_kind", "accession_number", F.array_join("quality_flags", ",").alias("flags"))


@query(f"""
WITH {_FACT_DOCUMENTS_SQL} SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS cik, 'Revenues' AS concept, fy AS fiscal_year, CAST(CAST(v AS DECIMAL(28,2)) AS VARCHAR) AS value FROM s WHERE fy % 2 = 0""")
def companyfacts_filters(spark, d):
    """Taxonomy, concept and form filters."""
    rows = normalize.normalize_companyfacts(_fact_documents(spark, d), taxonomies=["us-gaap"], concepts=["Revenues", "Quantity"], forms=["10-K"])
    return rows.select("cik", "concept", "fiscal_year", _money("value").alias("value"))


# --- rows of the repositories ----------------------------------------------------------------------------


@query(f"""
WITH {_CALENDAR_SQL}, l AS (
  SELECT cik, max(filing_date) FILTER (form_type = '10-K') AS k, max(filing_date) FILTER (form_type = '10-Q') AS q FROM filings GROUP BY cik
), due AS (SELECT *, CAST(k + INTERVAL 12 MONTH AS DATE) AS dk, CAST(q + CASE WHEN quarter(q) = 3 THEN INTERVAL 6 MONTH ELSE INTERVAL 3 MONTH END AS DATE) AS dq FROM l)
SELECT cik, CASE WHEN CAST(cik AS INT) % 5 <> 0 THEN 'Customer ' || CAST(cik AS INT) ELSE CASE WHEN CAST(cik AS INT) % 2 = 0 THEN 'Entity ' || CAST(cik AS INT) END END AS name,
  CASE WHEN CAST(cik AS INT) % 3 <> 0 THEN 'C' || CAST(cik AS INT) END AS ticker, CAST(k AS VARCHAR) AS latest_10k, CAST(q AS VARCHAR) AS latest_10q,
  CAST((SELECT max(day) FROM open WHERE day <= dk) AS VARCHAR) AS next_10k, CAST((SELECT max(day) FROM open WHERE day <= dq) AS VARCHAR) AS next_10q FROM due""", orders=True)
def company_rows(spark, d):
    """Names from the facts, else the submissions; first tickers; latest filings and the days of the next checks."""
    profile = companies.company_profile(_submissions(spark, d))
    told = profile.filter("name is null and cast(cik as int) % 2 = 0").select("cik", F.concat(F.lit("Entity "), F.col("cik").cast("int")).alias("entity_name"))
    none = spark.createDataFrame([], "ticker string, cik string, title string")
    filed = adapter.order_filings(spark, d).withColumn("fiscal_period", F.concat(F.lit("Q"), F.quarter("filing_date")))
    rows = companies.build_companies(profile, told, none, filed.filter("form_type <> '8-K'"))
    rows = rows.join(filed.select("cik").distinct(), "cik", "left_semi")
    return rows.select("cik", "name", "ticker", _day("latest_10k_filing_date").alias("latest_10k"), _day("latest_10q_filing_date").alias("latest_10q"), _day("next_check_date_10k").alias("next_10k"), _day("next_check_date_10q").alias("next_10q"))


def _line_facts(spark, d) -> DataFrame:
    """Line items as facts of the orders they belong to; a fourth of the orders have none."""
    o = adapter.order_filings(spark, d)
    day = F.col("l_shipdate").cast("date")
    lines = table(spark, d, "lineitem").filter("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("pos"), day.alias("end_date"), F.year(day).alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter(day)).alias("fiscal_period"))
    return lines.join(o.select("pos", "cik", "accession_number", F.col("form_type").alias("form")), "pos")


@query("""
WITH l AS (
  SELECT l_orderkey AS pos, CAST(year(l_shipdate) AS INT) AS fy, 'Q' || quarter(l_shipdate) AS fp, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS report_date FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY ALL
), p AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY pos ORDER BY fy DESC, fp DESC) = 1)
SELECT cik, accession_number, form_type, report_date, fy AS fiscal_year, fp AS fiscal_period, CASE WHEN pos % 3 = 0 THEN '/filings/' || pos END AS local_path, pos % 10 = 3 OR p.pos IS NULL AS is_active
FROM filings LEFT JOIN p USING (pos)""", orders=True)
def filing_rows(spark, d):
    """Filings with the period of their facts, their local copies, and whether they are active."""
    o = adapter.order_filings(spark, d)
    copies = o.filter("pos % 3 = 0").select("accession_number", F.concat(F.lit("/filings/"), "pos").alias("local_path"))
    rows = filings.build_filings(o.withColumn("document_url", F.lit("")), _line_facts(spark, d), o.filter("pos % 10 = 3").select("cik", "accession_number"), copies)
    return rows.select("cik", "accession_number", "form_type", _day("report_date").alias("report_date"), "fiscal_year", "fiscal_period", "local_path", F.col("is_active_window").alias("is_active"))


@query("""
SELECT lpad(CAST(pos % 97 AS VARCHAR), 10, '0') AS cik, lpad(CAST(pos % 97 AS VARCHAR), 10, '0') || '-24-' || pos AS accession_number, form_type AS form,
  CASE WHEN pos % 3 = 0 THEN 'local' || pos || '.htm' WHEN pos % 3 = 1 THEN 'd' || pos || '.htm' ELSE '' END AS primary_document FROM filings""", orders=True)
def filing_records(spark, d):
    """Stored filings told as the source tells them: who filed, and the document's name from the copy or the address."""
    o, pos = adapter.order_filings(spark, d), F.col("pos")
    o = o.withColumn("accession_number", F.concat(F.lpad((pos % 97).cast("string"), 10, "0"), F.lit("-24-"), pos))
    o = o.withColumn("local_path", F.when(pos % 3 == 0, F.concat(F.lit("/base/x\\local"), pos, F.lit(".htm")))).withColumn("document_url", F.when(pos % 3 == 1, F.concat(F.lit("https://x.org/a/d"), pos, F.lit(".htm/"))))
    return filings.of_record(o).select("cik", "accession_number", "form", "primary_document")


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 3 <> 0 AS known, c_custkey % 4 = 0 AS fresh, c_custkey % 5 = 0 AS failed, c_custkey % 2 AS n_new FROM customer)
SELECT c_custkey, CASE WHEN known AND fresh THEN 'reused_local' WHEN known AND failed THEN 'refresh_failed_using_local_data' WHEN failed THEN NULL WHEN NOT known THEN 'initialized' WHEN n_new > 0 THEN 'updated' ELSE 'checked_no_update' END AS status FROM c""")
def ingestion_statuses(spark, d):
    """The five outcomes of a run; none where an unknown company could not be fetched."""
    c = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", companies.status(c % 3 != 0, c % 2, due=c % 4 != 0, failed=c % 5 == 0).alias("status"))


@query(f"""
WITH {_CALENDAR_SQL}, soon AS (SELECT min(day) AS s FROM open WHERE day >= DATE '2000-07-01'),
n AS (SELECT cik, max(filing_date) FILTER (form_type = '10-K') AS k, max(filing_date) FILTER (form_type = '10-Q') AS q FROM filings GROUP BY cik)
SELECT cik, CAST(CASE WHEN k IS NULL OR k <= DATE '2000-06-30' THEN s ELSE k END AS VARCHAR) AS next_10k, CAST(CASE WHEN q IS NULL OR q <= DATE '2000-06-30' THEN s ELSE q END AS VARCHAR) AS next_10q FROM n, soon""", orders=True)
def postponed_checks(spark, d):
    of = lambda form: F.max(F.when(F.col("form_type") == form, F.col("filing_date")))
    rows = adapter.order_filings(spark, d).groupBy("cik").agg(of("10-K").alias("next_check_date_10k"), of("10-Q").alias("next_check_date_10q"))
    return companies.postpone_checks(rows, "2000-06-30").select("cik", _day("next_check_date_10k").alias("next_10k"), _day("next_check_date_10q").alias("next_10q"))


def _keyed(spark, name: str, ddl: str, key: str) -> KeyedTable:
    return KeyedTable(spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}", ddl, [key], deal_by=key, buckets=8)


@query(f"""
WITH {catalog._BATCH_SQL}, m AS (
  SELECT coalesce(b.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN c.c_name ELSE b.c_name END AS c_name, CASE WHEN b.c_custkey IS NULL THEN c.c_mktsegment ELSE b.c_mktsegment END AS c_mktsegment FROM customer c FULL JOIN batch b ON b.c_custkey = c.c_custkey)
SELECT * FROM m WHERE c_custkey % 11 <> 0""")
def stored_merge(spark, d):
    """A stored table: put, merged twice with the same batch (all columns replaced, also by NULL), some keys deleted, read."""
    stored = _keyed(spark, "customers", "c_custkey long, c_name string, c_mktsegment string", "c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    stored.put(rows, rows)
    batch = staged(catalog._batch(spark, d), "batch")
    for _ in range(2):
        stored.merge(batch, order="seq")
    stored.delete(stored.read().filter("c_custkey % 11 = 0"))
    return stored.read()


@query("""
SELECT cik, accession_number, upper(form_type) AS form_type, CASE WHEN pos % 6 = 0 THEN '/new' WHEN pos % 3 = 0 THEN '/old' END AS local_path, pos % 2 = 0 AS is_new FROM filings""", orders=True)
def filings_upsert(spark, d):
    """Filings replaced by accession; a copy that is told again replaces the old path, else the old one stays."""
    o, pos = adapter.order_filings(spark, d), F.col("pos")
    old = o.select("cik", "accession_number", "form_type", F.when(pos % 3 == 0, "/old").alias("local_path"), F.lit(False).alias("is_new"), "pos")
    new = o.filter(pos % 2 == 0).select("cik", "accession_number", "form_type", F.when(pos % 6 == 0, "/new").alias("local_path"), F.lit(True).alias("is_new"), "pos")
    kept = merge.upsert(old, new, ["accession_number"], order="pos")
    paths = merge.partial_update(kept, old.select("accession_number", F.when(~(pos % 6 == 0), F.col("local_path")).alias("local_path")), ["accession_number"], ["local_path"])
    return paths.select("cik", "accession_number", "form_type", "local_path", "is_new")


@query("SELECT cik, metric_name, fiscal_year, fiscal_period, count(*) AS n, CAST(max(value + CASE WHEN CAST(cik AS INT) % 2 = 0 THEN 1 ELSE 0 END) AS VARCHAR) AS value FROM metrics GROUP BY ALL", facts=True)
def metrics_upsert(spark, d):
    """Metrics recalculated for half of the companies replace those of their fact and name; nothing multiplies."""
    made = staged(_metrics(spark, d), "metrics")
    again = made.filter("cast(cik as int) % 2 = 0").withColumn("value", (F.col("value") + 1).cast("decimal(38,10)")).withColumn("batch_pos", F.lit(1))
    rows = merge.upsert(made, again, ["metric_id"], order="batch_pos").withColumn("v", _money("value"))
    return rows.groupBy("cik", "metric_name", "fiscal_year", "fiscal_period").agg(F.count("*").alias("n"), F.max(F.col("value").cast("decimal(28,2)")).cast("string").alias("value"))


@query(f"WITH {_INDICATORS_SQL} SELECT cik, indicator_name, fiscal_year, fiscal_period, CASE WHEN CAST(cik AS INT) % 2 = 0 THEN CAST(value AS VARCHAR) END AS value FROM indicators WHERE skip_reason IS NULL", facts=True)
def indicators_upsert(spark, d):
    """Stored indicators without values, half of the companies recalculated."""
    made = staged(indicators.calculate(_metrics(spark, d)), "indicators")
    old = made.withColumn("value", F.lit(None).cast("decimal(38,10)"))
    rows = merge.upsert(old, indicators.numbered(made.filter("cast(cik as int) % 2 = 0")), ["cik", "indicator_name", "period_type", "fiscal_year", "fiscal_period", "formula_version"], order="batch_pos")
    return rows.filter("calculation_status = 'calculated'").select("cik", "indicator_name", "fiscal_year", "fiscal_period", catalog._six("value").alias("value"))


@query(f"""
WITH {_INDICATORS_SQL}, i AS (SELECT * FROM indicators WHERE cik = '0000000001' AND skip_reason IS NULL)
SELECT indicator_name, fiscal_year, fiscal_period, CAST(value AS VARCHAR) AS value, CAST(row_number() OVER (ORDER BY indicator_name, fiscal_year DESC, fiscal_period DESC) AS INT) AS place FROM i""", facts=True)
def list_indicators(spark, d):
    rows = indicators.list_indicators(indicators.calculate(_metrics(spark, d)), "0000000001", calculated=True)
    return _placed(rows, indicators.listing_order()).select("indicator_name", "fiscal_year", "fiscal_period", catalog._six("value").alias("value"), "place")


@query("""
WITH active AS (SELECT * FROM metrics WHERE is_active), w AS (
  SELECT cik, fiscal_year, fiscal_period, CASE fiscal_period WHEN 'FY' THEN fiscal_year ELSE fiscal_year * 4 + CAST(fiscal_period[2] AS INT) END AS i,
    max(accession_number) FILTER (metric_name = 'revenue') AS revenue, max(accession_number) FILTER (metric_name = 'gross_profit') AS gross, max(accession_number) FILTER (metric_name = 'operating_income') AS op,
    max(accession_number) FILTER (metric_name = 'net_income') AS net, max(accession_number) FILTER (metric_name = 'total_assets') AS assets, max(accession_number) FILTER (metric_name = 'total_liabilities') AS liab,
    max(accession_number) FILTER (metric_name = 'current_assets') AS ca, max(accession_number) FILTER (metric_name = 'current_liabilities') AS cl, max(accession_number) FILTER (metric_name = 'operating_cash_flow') AS ocf,
    max(accession_number) FILTER (metric_name = 'capital_expenditure') AS capex FROM active GROUP BY cik, fiscal_year, fiscal_period
), p AS (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY cik, fiscal_period = 'FY' ORDER BY i) = i - 1 THEN lag(revenue) OVER (PARTITION BY cik, fiscal_period = 'FY' ORDER BY i) END AS before FROM w)
SELECT cik, fiscal_year, fiscal_period, unnest(['revenue_growth','gross_margin','operating_margin','net_margin','debt_ratio','current_ratio','free_cash_flow','cash_conversion']) AS indicator_name,
  unnest([array_to_string(list_sort(list_distinct([y FOR y IN x IF y IS NOT NULL])), ',') FOR x IN [[revenue, before], [gross, revenue], [op, revenue], [net, revenue], [liab, assets], [ca, cl], [ocf, capex], [ocf, net]]]) AS accessions, 'v1' AS formula_version
FROM p""", facts=True)
def indicator_sources(spark, d):
    """Which filings an indicator comes from, whether it could be calculated or not."""
    rows = indicators.calculate(_metrics(spark, d))
    return rows.select("cik", "fiscal_year", "fiscal_period", "indicator_name", F.array_join("source_accession_numbers", ",").alias("accessions"), "formula_version")


# --- listings ---------------------------------------------------------------------------------------------


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """With the place in the listing; ties share one. For the rows of one company."""
    return rows.withColumn("place", F.rank().over(Window.partitionBy("cik").orderBy(*order)).cast("int"))


@query("""
SELECT concept, CAST(end_date AS VARCHAR) AS end_date, accession_number, unit, CAST(value AS VARCHAR) AS value, CAST(rank() OVER (ORDER BY concept, end_date NULLS FIRST, accession_number NULLS FIRST, unit) AS INT) AS place
FROM facts WHERE cik = '0000000001' AND concept IN ('Assets', 'Revenues', 'OperatingIncomeLoss')""", facts=True)
def list_facts(spark, d):
    rows = metrics.list_facts(_facts(spark, d), "0000000001", ["Revenues", "Assets", "OperatingIncomeLoss"])
    return _placed(rows, metrics.fact_order()).select("concept", _day("end_date").alias("end_date"), "accession_number", "unit", _money("value").alias("value"), "place")


@query("SELECT accession_number, form_type, CAST(row_number() OVER (ORDER BY filing_date DESC, accession_number DESC) AS INT) AS place FROM filings WHERE cik = '0000000007' AND form_type IN ('10-K', '8-K') AND pos % 2 = 1", orders=True)
def list_filings(spark, d):
    rows = adapter.order_filings(spark, d).withColumn("is_active_window", F.col("pos") % 2 == 1)
    rows = filings.list_filings(rows, "0000000007", forms=["10-k", "8-K"], active=True)
    return _placed(rows, filings.listing_order()).select("accession_number", "form_type", "place")


@query("""
SELECT statement_type, metric_name, fiscal_year, fiscal_period, accession_number, CAST(row_number() OVER (ORDER BY statement_type, metric_name, fiscal_year DESC, fiscal_period DESC, accession_number DESC) AS INT) AS place
FROM metrics WHERE cik = '0000000001' AND is_active AND statement_type = 'income_statement' AND metric_name IN ('revenue', 'net_income', 'total_assets')""", facts=True)
def list_metrics(spark, d):
    rows = metrics.list_metrics(_metrics(spark, d), "0000000001", statement="income_statement", names=["net_income", "revenue", "total_assets"])
    return _placed(rows, metrics.metric_order()).select("statement_type", "metric_name", "fiscal_year", "fiscal_period", "accession_number", "place")


@query("""
SELECT a.accession_number, f.cik, f.form_type FROM (SELECT DISTINCT lpad(CAST(l_orderkey + l_suppkey % 3 AS VARCHAR), 12, '0') AS accession_number FROM lineitem) a LEFT JOIN filings f USING (accession_number)""", orders=True)
def find_filings(spark, d):
    """Filings by accession; some accessions name none."""
    asked = table(spark, d, "lineitem").select(F.lpad((F.col("l_orderkey") + F.col("l_suppkey") % 3).cast("string"), 12, "0").alias("accession_number"))
    return filings.find_filings(adapter.order_filings(spark, d), asked).select("accession_number", "cik", "form_type")


@query("""
SELECT o.ordering, f.accession_number, CAST(CASE o.ordering WHEN 'selection' THEN row_number() OVER (PARTITION BY o.ordering ORDER BY filing_date, accession_number) WHEN 'report' THEN row_number() OVER (PARTITION BY o.ordering ORDER BY form_type DESC, filing_date DESC, accession_number)
  ELSE row_number() OVER (PARTITION BY o.ordering ORDER BY CASE form_type WHEN '10-K' THEN 0 WHEN '10-Q' THEN 1 ELSE 2 END, form_type, filing_date DESC, accession_number) END AS INT) AS place
FROM filings f, (VALUES ('selection'), ('report'), ('form')) o(ordering) WHERE cik = '0000000007'""", orders=True)
def filing_orders(spark, d):
    """A company's filings in each of the three orders."""
    mine = adapter.order_filings(spark, d).filter("cik = '0000000007'")
    out = None
    for by in ("selection", "report", "form"):
        one = _placed(filings.ordered(mine, by), filings.ordering(by)).select(F.lit(by).alias("ordering"), "accession_number", "place")
        out = one if out is None else out.unionByName(one)
    return out


@query(r"""
SELECT page_id, NOT regexp_matches(url, '[/\\]') AND NOT contains(url, '..') AS safe, regexp_extract(url, '([^/\\]+)$', 1) AS base_name, CASE WHEN regexp_full_match(trim(regexp_extract(url, '([0-9]+)', 1)), '[0-9]{1,10}') THEN lpad(regexp_extract(url, '([0-9]+)', 1), 10, '0') END AS cik
FROM pages""")
def input_checks(spark, d):
    """Names that may become paths, names at the end of addresses, numbers that may be a CIK."""
    return table(spark, d, "pages").select("page_id", S.safe_name("url").alias("safe"), S.base_name("url").alias("base_name"), S.normalize_cik(F.regexp_extract("url", "([0-9]+)", 1)).alias("cik"))


@query("""
SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY first), ',') AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY o_custkey""")
def deduped_in_order(spark, d):
    """Each priority of a customer once, where it came first."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o"))
    return rows.select("o_custkey", F.array_join(S.deduped(F.col("o.o_orderpriority")), ",").alias("priorities"))


# --- reports ------------------------------------------------------------------------------------------------

_CELL_SQL = r"replace(regexp_replace(coalesce(text, ''), '\r\n|\n|\r', ' ', 'g'), '|', '/')"


@query(f"SELECT doc_id, CASE WHEN length({_CELL_SQL}) > 120 THEN substr({_CELL_SQL}, 1, 117) || '...' ELSE {_CELL_SQL} END AS cell FROM documents")
def markdown_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", S.cell("text").alias("cell"))


@query("""
SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(replace(lower(p_type), '_', ' '), ' ')], ' ') AS title, p_size || CASE p_size WHEN 1 THEN ' piece' ELSE ' pieces' END AS pieces,
  CASE WHEN p_size % 3 = 0 THEN 'unknown' WHEN p_size % 3 = 1 THEN 'yes' ELSE 'no' END AS told FROM part""")
def report_labels(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", S.title(F.lower("p_type")).alias("title"), S.counted(size, "piece").alias("pieces"), S.yes_no(F.when(size % 3 != 0, size % 3 == 1)).alias("told"))


_SECTION_SQL = "CASE WHEN concept IN ('Assets','AssetsCurrent','Liabilities','LiabilitiesCurrent') THEN 'Balance sheet' WHEN concept LIKE 'NetCash%' OR concept LIKE 'Payments%' THEN 'Cash flow statement' ELSE 'Income statement' END"


def _joined_sql(items: str, limit: int) -> str:
    return f"CASE WHEN len({items}) > {limit} THEN array_to_string({items}[1:{limit}], ', ') || ' ... (+' || (len({items}) - {limit}) || ' more)' ELSE array_to_string({items}, ', ') END"


@query(f"""
WITH f AS (SELECT *, {_SECTION_SQL} AS section, {_LABEL_SQL} AS label FROM facts),
p AS (SELECT section, concept, list(label ORDER BY fiscal_year DESC, fiscal_period = 'FY' DESC, fiscal_period DESC) AS l FROM (SELECT DISTINCT section, concept, label, fiscal_year, fiscal_period FROM f) GROUP BY ALL),
n AS (SELECT section, concept, count(*) AS n FROM f GROUP BY ALL)
SELECT section, '' AS place, '- ' || section || ': ' || count(*) || CASE count(*) WHEN 1 THEN ' concept, ' ELSE ' concepts, ' END || sum(n) || CASE sum(n) WHEN 1 THEN ' stored fact' ELSE ' stored facts' END AS line FROM n GROUP BY section
UNION ALL SELECT section, 'us-gaap:' || concept, '  - us-gaap:' || concept || ': ' || n || CASE n WHEN 1 THEN ' fact' ELSE ' facts' END || '; units: USD; periods: ' || {_joined_sql('l', 8)} FROM n JOIN p USING (section, concept)""", facts=True)
def section_lines(spark, d):
    return report.section_lines(_stored_facts(spark, d))


@query(f"""
WITH p AS (SELECT statement_type, metric_name, list(label ORDER BY fiscal_year DESC, fiscal_period = 'FY' DESC, fiscal_period DESC) AS l FROM (SELECT DISTINCT statement_type, metric_name, {_LABEL_SQL} AS label, fiscal_year, fiscal_period FROM metrics WHERE is_active) GROUP BY ALL),
n AS (SELECT statement_type, metric_name, count(*) AS n FROM metrics WHERE is_active GROUP BY ALL),
t AS (SELECT *, CASE statement_type WHEN 'income_statement' THEN 'Income Statement' WHEN 'balance_sheet' THEN 'Balance Sheet' ELSE 'Cash Flow Statement' END AS title FROM n)
SELECT statement_type AS section, '' AS place, '- ' || any_value(title) || ': ' || count(*) || CASE count(*) WHEN 1 THEN ' metric name, ' ELSE ' metric names, ' END || sum(n) || CASE sum(n) WHEN 1 THEN ' metric value' ELSE ' metric values' END AS line FROM t GROUP BY statement_type
UNION ALL SELECT statement_type, metric_name, '  - ' || metric_name || ': ' || n || CASE n WHEN 1 THEN ' value' ELSE ' values' END || '; units: USD; periods: ' || {_joined_sql('l', 8)} FROM n JOIN p USING (statement_type, metric_name)""", facts=True)
def metric_lines(spark, d):
    return report.metric_lines(staged(_metrics(spark, d), "metrics").filter("is_active_window"))


@query("SELECT cik, count(*) AS n_facts, count(DISTINCT concept) AS n_concepts, CAST(max(end_date) AS VARCHAR) AS report_date, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(string_split(g.flags, ',')) AS x FROM facts g WHERE g.cik = f.cik AND g.flags <> '')), '') AS flags FROM facts f GROUP BY cik", facts=True)
def fact_summary(spark, d):
    return inventory.fact_summary(_facts(spark, d)).select("cik", "n_facts", "n_concepts", _day("report_date").alias("report_date"), F.array_join("flags", ",").alias("flags"))


@query("SELECT statement_type, count(DISTINCT metric_name) AS n_names, count(*) AS n_values FROM metrics GROUP BY 1", facts=True)
def statement_report(spark, d):
    return inventory.statement_report(_metrics(spark, d))


def _read_csv(spark, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


@query("SELECT concept, cik, CAST(value AS VARCHAR) AS value, CASE WHEN flags = '' THEN '[]' ELSE '[\"' || replace(flags, ',', '\",\"') || '\"]' END AS quality_flags FROM facts", facts=True)
def facts_csv(spark, d):
    """All facts as CSV, read back."""
    path = f"{folder(spark)}/facts-{uuid.uuid4().hex}.csv"
    rows = _facts(spark, d).select("concept", "cik", "end_date", "accession_number", "unit", _money("value").alias("value"), "quality_flags")
    if warned := inventory.export_csv(rows, path, metrics.fact_order()):
        raise OSError(warned[0])
    return spark.read.option("escape", "\\").csv(path, header=True).select("concept", "cik", "value", "quality_flags")


@query(f"WITH {_INDICATORS_SQL} SELECT cik, indicator_name, CAST(fiscal_year AS VARCHAR) AS fiscal_year, fiscal_period, CAST(value AS VARCHAR) AS value FROM indicators", facts=True)
def indicators_csv(spark, d):
    path = f"{folder(spark)}/indicators-{uuid.uuid4().hex}.csv"
    rows = indicators.calculate(_metrics(spark, d)).withColumn("value", catalog._six("value"))
    if warned := inventory.export_csv(rows, path, [F.col("cik"), *indicators.listing_order()]):
        raise OSError(warned[0])
    return _read_csv(spark, path).select("cik", "indicator_name", "fiscal_year", "fiscal_period", "value")


# --- texts and evidence ----------------------------------------------------------------------------------------

_SENTENCES_SQL = r"""
texts AS (SELECT doc_id, 'Item ' || (doc_id % 15 + 1) || '. ' || coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM texts),
numbered AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS n FROM parts),
sent AS (SELECT * FROM numbered WHERE trim(s) <> ''),
placed AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 512 AS piece FROM sent),
pieces AS (SELECT doc_id, piece, string_agg(s, ' ' ORDER BY n) AS chunk, count(*) AS n_sentences FROM placed GROUP BY ALL)"""


def _headed(spark, d) -> DataFrame:
    """Documents as filing texts with a heading."""
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("Item "), F.col("doc_id") % 15 + 1, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))


@query(f"""WITH {_SENTENCES_SQL} SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS INT) AS chunk_no, sha256(chunk) AS chunk_sha256, CAST(n_sentences AS INT) AS n_sentences FROM pieces""")
def sentence_chunks(spark, d):
    rows = retrieval.sentence_chunks(_headed(spark, d), id_col="doc_id", text_col="text")
    return rows.select("id", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha256"), "n_sentences")


@query(f"""
WITH {_SENTENCES_SQL}
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS accession_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS INT) AS chunk_no, CAST(doc_id % 15 + 1 AS VARCHAR) AS section, f.cik, f.form_type, CAST(f.filing_date AS VARCHAR) AS filing_date,
  'C' || CAST(f.cik AS INT) AS ticker, CASE WHEN f.cik IS NULL THEN 'cik,form_type,ticker' ELSE '' END AS missing
FROM pieces LEFT JOIN filings f ON f.pos = doc_id""", orders=True)
def chunk_metadata(spark, d):
    """Pieces with ticker, CIK, form, filing date and section; what is missing is told."""
    texts = _headed(spark, d).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("accession_number"), "text")
    filed = adapter.order_filings(spark, d).withColumn("source", F.lit("SEC"))
    listed = filed.select("cik", F.concat(F.lit("C"), F.col("cik").cast("int")).alias("ticker")).distinct()
    rows = staged(retrieval.filing_chunks(texts, filed, listed), "chunks")
    lacking = retrieval.missing_metadata(rows, ["cik", "form_type", "ticker"])
    rows = rows.join(lacking, ["id", "chunk_no"], "left")
    return rows.select("accession_number", F.col("chunk_no").cast("int").alias("chunk_no"), "section", "cik", "form_type", _day("filing_date").alias("filing_date"), "ticker", F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"))


@query("SELECT doc_id AS id, CAST(1 + CAST(doc_id % 2 = 0 AS INT) AS INT) AS n_sections, (doc_id % 15 + 1) || CASE WHEN doc_id % 2 = 0 THEN ',7A' ELSE '' END AS sections FROM documents")
def sections_found(spark, d):
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" ITEM 7a: more. Item 7A. again"))).otherwise(F.col("text"))
    rows = retrieval.sections(_headed(spark, d).withColumn("text", text), id_col="doc_id", text_col="text")
    return rows.select("id", "n_sections", F.array_join("sections", ",").alias("sections"))


@query("""
WITH q AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (
  SELECT q.vec_id AS query_id, round(list_cosine_similarity([CAST(x AS DOUBLE) FOR x IN e.embedding], q.e), 6) AS score FROM q JOIN embeddings e ON q.vec_id <> e.vec_id
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= 5)
SELECT query_id, count(*) AS n_results, max(score) AS best, max(score) < 0.4 AS is_weak FROM s GROUP BY 1 UNION ALL SELECT vec_id, 0, NULL, true FROM embeddings WHERE vec_id % 20 = 1""")
def weak_results(spark, d):
    """Which questions have only weak answers, or none."""
    rows = table(spark, d, "embeddings")
    found = retrieval.vector_topk(rows, rows.filter("vec_id % 20 = 0"), id_col="vec_id", vector_col="embedding")
    return retrieval.flag_weak(found, rows.filter("vec_id % 20 < 2"), query_id="vec_id", minimum=0.4)


@query("""
SELECT 'questions' AS section, '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS line FROM conversations WHERE role = 'user'
UNION ALL SELECT 'answers', '{"conv_id":' || conv_id || ',"n":' || count(*) || '}' FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def answer_sections(spark, d):
    rows = table(spark, d, "conversations")
    answers = rows.filter("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return evidence.answer_sections({"questions": rows.filter("role = 'user'").select("conv_id", "turn"), "answers": answers})


@query("SELECT 'local' AS provider, event_type AS model, 'answer' AS task, count(*) AS n_calls, round(avg(user_id), 6) AS mean_latency_ms, CAST(sum(user_id + event_id % 100) AS BIGINT) AS n_tokens FROM events GROUP BY event_type")
def call_totals(spark, d):
    """The log of model calls, by provider, model and task; events stand in for calls."""
    log = table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("call_id"), F.lit("local").alias("provider"), F.col("event_type").alias("model"), F.lit("answer").alias("task"),
        F.col("user_id").alias("latency_ms"), F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"), F.col("ts").alias("called_at"),
    )
    return evidence.call_totals(log).withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))
