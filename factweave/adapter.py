"""Order tables read as facts and filings, with planted defects.

An analogue for checks at any scale, not filing data: a supplier is a company, a
quarter's or year's line items are a filing, their sums its facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sums(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).cast("decimal(28,4)").alias(c) for c in ("rev", "disc", "qty", "tax")), F.min("first").alias("first"), F.max("last").alias("last"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact entries as they come out of a flattened document."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    day = F.col("l_shipdate").cast("date")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supp"), F.year(day).alias("fy"), F.quarter(day).alias("q"), day.alias("first"), day.alias("last"),
        (money("l_extendedprice") * (1 - money("l_discount"))).alias("rev"), (money("l_extendedprice") * money("l_discount")).alias("disc"),
        money("l_quantity").alias("qty"), (money("l_extendedprice") * money("l_tax")).alias("tax"),
    )
    quarters = _sums(lines, "supp", "fy", "q")
    periods = quarters.unionByName(_sums(quarters, "supp", "fy").withColumn("q", F.lit(0)))
    m = (F.col("supp") * 31 + F.col("fy") * 4 + F.col("q")) % 23
    value = lambda x: F.expr(f"cast(cast({x} as decimal(28,2)) as string)")
    # concept, value, is it instant
    concepts = [
        ("Revenues", "rev", 0), ("CostOfRevenue", "disc", 0), ("GrossProfit", "rev - disc", 0), ("OperatingIncomeLoss", "rev - 2 * disc", 0), ("NetIncomeLoss", "rev - 10 * tax", 0),
        ("Assets", "qty * 1000", 1), ("Liabilities", "qty * 600", 1), ("AssetsCurrent", "qty * 300", 1), ("LiabilitiesCurrent", "case when supp % 7 = 0 then 0 else qty * 200 end", 1),
        ("NetCashProvidedByUsedInOperatingActivities", "rev - 3 * disc", 0), ("PaymentsToAcquirePropertyPlantAndEquipment", "2 * disc", 0), ("ResearchAndDevelopmentExpense", "tax", 0),
    ]
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("concept"), value(x).alias("val"), F.lit(i).alias("instant")) for c, x, i in concepts)))
    rows = periods.select("*", m.alias("m"), told.alias("c")).select("*", "c.*")
    at = lambda n, c: (F.col("m") == n) & (F.col("concept") == c)
    fp = F.when(F.col("q") == 0, "FY").otherwise(F.concat(F.lit("Q"), F.col("q")))
    rows = rows.select(
        F.lpad(F.col("supp").cast("string"), 10, "0").alias("cik"), F.concat(F.lit("Supplier "), "supp").alias("entity_name"), F.lit("us-gaap").alias("taxonomy"), "concept",
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("description"), F.lit("USD").alias("unit"), F.lit(0).alias("pos"),
        F.when(at(9, "Liabilities"), 2).otherwise(1).alias("n_units"),
        F.when(at(1, "Revenues"), None).when(at(2, "GrossProfit"), "n/a").otherwise(F.col("val")).alias("val"),
        F.when(F.col("instant") == 1, None).when(at(5, "NetIncomeLoss"), F.date_add("last", 10)).otherwise(F.col("first")).cast("string").alias("start"),
        F.when(at(3, "Assets"), "").when(at(4, "Assets"), "bad-date").otherwise(F.col("last").cast("string")).alias("end"),
        F.col("fy").cast("string").alias("fy"), fp.alias("fp"),
        F.when(F.col("m") == 6, "10-K/A").when(at(7, "CostOfRevenue"), None).when(F.col("q") == 0, "10-K").otherwise("10-Q").alias("form"),
        F.date_add("last", 30).cast("string").alias("filed"),
        F.when(at(8, "OperatingIncomeLoss"), None).otherwise(F.concat_ws("-", F.lpad(F.col("supp").cast("string"), 10, "0"), F.substring(F.col("fy").cast("string"), 3, 2), F.lpad(F.col("q").cast("string"), 6, "0"))).alias("accn"),
        F.lit(None).cast("string").alias("frame"), F.when(at(10, "Revenues"), 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).drop("times")


#: The same entries for DuckDB, as common table expressions.
ENTRIES_SQL = r"""
lines AS (
  SELECT l_suppkey AS supp, CAST(year(l_shipdate) AS INT) AS fy, CAST(quarter(l_shipdate) AS INT) AS q, CAST(l_shipdate AS DATE) AS d,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(18,2)) AS di, CAST(l_quantity AS DECIMAL(18,2)) AS qt, CAST(l_tax AS DECIMAL(18,2)) AS tx
  FROM lineitem
), sums AS (
  SELECT supp, fy, coalesce(q, 0) AS q, min(d) AS first, max(d) AS last, CAST(sum(p * (1 - di)) AS DECIMAL(28,4)) AS rev, CAST(sum(p * di) AS DECIMAL(28,4)) AS disc,
    CAST(sum(qt) AS DECIMAL(28,4)) AS qty, CAST(sum(p * tx) AS DECIMAL(28,4)) AS tax
  FROM lines GROUP BY GROUPING SETS ((supp, fy, q), (supp, fy))
), long AS (
  SELECT supp, fy, q, first, last, (supp * 31 + fy * 4 + q) % 23 AS m,
    unnest(['Revenues','CostOfRevenue','GrossProfit','OperatingIncomeLoss','NetIncomeLoss','Assets','Liabilities','AssetsCurrent','LiabilitiesCurrent',
      'NetCashProvidedByUsedInOperatingActivities','PaymentsToAcquirePropertyPlantAndEquipment','ResearchAndDevelopmentExpense']) AS concept,
    unnest([CAST(CAST(x AS DECIMAL(28,2)) AS VARCHAR) FOR x IN [rev, disc, rev - disc, rev - 2 * disc, rev - 10 * tax, qty * 1000, qty * 600, qty * 300,
      CASE WHEN supp % 7 = 0 THEN 0 ELSE qty * 200 END, rev - 3 * disc, 2 * disc, tax]]) AS v
  FROM sums
), entries AS (
  SELECT lpad(CAST(supp AS VARCHAR), 10, '0') AS cik, 'us-gaap' AS taxonomy, concept, 'USD' AS unit, m = 9 AND concept = 'Liabilities' AS two_units,
    CASE WHEN m = 1 AND concept = 'Revenues' THEN NULL WHEN m = 2 AND concept = 'GrossProfit' THEN 'n/a' ELSE v END AS val,
    CASE WHEN concept IN ('Assets','Liabilities','AssetsCurrent','LiabilitiesCurrent') THEN NULL WHEN m = 5 AND concept = 'NetIncomeLoss' THEN last + 10 ELSE first END AS start_date,
    CASE WHEN m IN (3, 4) AND concept = 'Assets' THEN NULL ELSE last END AS end_date, m = 4 AND concept = 'Assets' AS bad_date,
    fy AS fiscal_year, CASE q WHEN 0 THEN 'FY' ELSE 'Q' || q END AS fiscal_period,
    CASE WHEN m = 6 THEN '10-K/A' WHEN m = 7 AND concept = 'CostOfRevenue' THEN NULL WHEN q = 0 THEN '10-K' ELSE '10-Q' END AS form, last + 30 AS filed_date,
    CASE WHEN m = 8 AND concept = 'OperatingIncomeLoss' THEN NULL ELSE lpad(CAST(supp AS VARCHAR), 10, '0') || '-' || substr(CAST(fy AS VARCHAR), 3, 2) || '-' || lpad(CAST(q AS VARCHAR), 6, '0') END AS accession_number,
    CASE WHEN m = 10 AND concept = 'Revenues' THEN 2 ELSE 1 END AS times
  FROM long
), facts AS (
  SELECT e.* EXCLUDE (times, two_units, bad_date, val), val AS value_raw, TRY_CAST(val AS DECIMAL(28,2)) AS value,
    concat_ws(',',
      CASE WHEN val IS NULL THEN 'missing_value' END, CASE WHEN val = 'n/a' THEN 'non_numeric_value' END, CASE WHEN end_date IS NULL THEN 'missing_end_date' END,
      CASE WHEN start_date > end_date THEN 'inconsistent_period' END, CASE WHEN bad_date THEN 'invalid_date' END, CASE WHEN form IS NULL THEN 'missing_form' END,
      CASE WHEN form NOT IN ('10-K', '10-Q') THEN 'unsupported_form' END, CASE WHEN accession_number IS NULL THEN 'missing_accession_number' END,
      CASE WHEN two_units THEN 'ambiguous_unit' END, CASE WHEN times > 1 THEN 'duplicate_fact' END) AS flags,
    CASE WHEN end_date IS NULL THEN 'unknown' WHEN start_date IS NULL THEN 'instant' ELSE 'duration' END AS period_type
  FROM entries e, range(times)
), keys AS (
  SELECT cik, form, fiscal_year, fiscal_period FROM (
    SELECT *, dense_rank() OVER (PARTITION BY cik, form ORDER BY fiscal_year DESC, fiscal_period DESC) AS r
    FROM (SELECT DISTINCT cik, form, fiscal_year, fiscal_period FROM facts WHERE (form = '10-K' AND fiscal_period = 'FY') OR (form = '10-Q' AND fiscal_period LIKE 'Q%'))
  ) WHERE r <= CASE form WHEN '10-K' THEN 5 ELSE 12 END
), mapping(concept, statement_type, metric_name) AS (
  VALUES ('Revenues','income_statement','revenue'), ('CostOfRevenue','income_statement','cost_of_revenue'), ('GrossProfit','income_statement','gross_profit'),
    ('OperatingIncomeLoss','income_statement','operating_income'), ('NetIncomeLoss','income_statement','net_income'), ('Assets','balance_sheet','total_assets'),
    ('AssetsCurrent','balance_sheet','current_assets'), ('Liabilities','balance_sheet','total_liabilities'), ('LiabilitiesCurrent','balance_sheet','current_liabilities'),
    ('NetCashProvidedByUsedInOperatingActivities','cash_flow_statement','operating_cash_flow'), ('PaymentsToAcquirePropertyPlantAndEquipment','cash_flow_statement','capital_expenditure')
), metrics AS (
  SELECT f.*, statement_type, metric_name, k.cik IS NOT NULL AS is_active
  FROM facts f JOIN mapping USING (concept) LEFT JOIN keys k ON f.cik = k.cik AND f.form = k.form AND f.fiscal_year = k.fiscal_year AND f.fiscal_period = k.fiscal_period
  WHERE accession_number IS NOT NULL AND f.form IS NOT NULL AND value IS NOT NULL AND NOT regexp_matches(flags, 'ambiguous_unit|duplicate_fact|missing_accession|missing_form|missing_value|non_numeric|unsupported')
)"""


def order_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of their customers; the finished ones are 10-K, the open ones 10-Q, others 8-K."""
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession_number"),
        form.alias("form_type"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderkey").alias("pos"),
    )


ORDERS_SQL = r"""
filings AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession_number,
    CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form_type, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS pos
  FROM orders
), accessions AS (SELECT cik, accession_number FROM filings WHERE pos % 10 = 3)"""
