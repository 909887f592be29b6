"""Tables as Spark DDL, and the fixed values that results depend on."""

from __future__ import annotations

FACTS = (
    "fact_id string, unique_key string, cik string, entity_name string, taxonomy string, concept string, label string, description string, unit string, "
    "value_raw string, value decimal(38,10), start_date date, end_date date, period_type string, fiscal_year int, fiscal_period string, form string, "
    "filed_date date, accession_number string, frame string, source string, quality_flags array<string>, batch_pos long, value_kind string, created_at timestamp"
)
COMPANIES = (
    "cik string, name string, ticker string, exchange string, sic string, sic_description string, latest_10k_filing_date date, latest_10q_filing_date date, "
    "next_check_date_10k date, next_check_date_10q date, created_at timestamp, updated_at timestamp, company_id long"
)
FILINGS = (
    "cik string, accession_number string, form_type string, filing_date date, report_date date, fiscal_year int, fiscal_period string, source string, "
    "document_url string, local_path string, is_active_window boolean, filing_id long, company_id long, ingested_at timestamp"
)
METRICS = (
    "metric_id string, cik string, accession_number string, raw_fact_id string, statement_type string, metric_name string, value decimal(38,10), value_raw string, "
    "unit string, period_type string, fiscal_year int, fiscal_period string, start_date date, end_date date, filing_date date, is_active_window boolean, "
    "filing_id long, company_id long, created_at timestamp"
)
INDICATORS = (
    "cik string, indicator_name string, formula_name string, formula_version string, value decimal(38,10), unit string, period_type string, fiscal_year int, fiscal_period string, "
    "end_date date, filing_date date, source_metric_ids array<string>, source_raw_fact_ids array<string>, source_accession_numbers array<string>, "
    "is_active_window boolean, calculation_status string, skip_reason string"
)
INDICATOR_KEY = ("cik", "indicator_name", "period_type", "fiscal_year", "fiscal_period", "formula_version")
#: One JSON fact entry before normalisation; values keep their JSON type.
ENTRY = "val variant, start string, end string, fy string, fp string, form string, filed string, accn string, frame string"
COMPANYFACTS = f"cik string, entityName string, facts map<string, map<string, struct<label:string, description:string, units:map<string, array<struct<{', '.join(x.strip().replace(' ', ':') for x in ENTRY.split(','))}>>>>>>"
SUBMISSIONS = (
    "cik string, name string, tickers array<string>, exchanges array<string>, sic string, sicDescription string, "
    "filings struct<recent:struct<accessionNumber:array<string>, filingDate:array<string>, form:array<string>, primaryDocument:array<string>>>"
)
TICKERS = "map<string, struct<cik_str:bigint, ticker:string, title:string>>"

# --- fixed values ---------------------------------------------------------------------------------

IDENTITY = ("cik", "taxonomy", "concept", "unit", "start_date", "end_date", "fiscal_year", "fiscal_period", "form", "accession_number", "frame")

SUPPORTED_FORMS = ("10-K", "10-Q")
DEFAULT_TAXONOMIES = ("us-gaap",)
PERIOD_ORDER = {"Q1": 1, "Q2": 2, "Q3": 3, "Q4": 4, "FY": 5}
ACTIVE_YEARS, ACTIVE_QUARTERS = 5, 12

#: In the order in which a fact's flags are listed.
FLAGS = (
    "missing_value", "non_numeric_value", "missing_end_date", "inconsistent_period", "invalid_date",
    "missing_form", "unsupported_form", "missing_accession_number", "ambiguous_unit", "duplicate_fact",
)
#: Flags that keep a fact from becoming a metric.
DISQUALIFYING = ("ambiguous_unit", "duplicate_fact", "missing_accession_number", "missing_form", "missing_value", "non_numeric_value", "unsupported_form")

#: concept, statement, metric
BASE_METRICS = (
    ("RevenueFromContractWithCustomerExcludingAssessedTax", "income_statement", "revenue"),
    ("Revenues", "income_statement", "revenue"),
    ("CostOfRevenue", "income_statement", "cost_of_revenue"),
    ("GrossProfit", "income_statement", "gross_profit"),
    ("OperatingIncomeLoss", "income_statement", "operating_income"),
    ("NetIncomeLoss", "income_statement", "net_income"),
    ("CashAndCashEquivalentsAtCarryingValue", "balance_sheet", "cash_and_equivalents"),
    ("Assets", "balance_sheet", "total_assets"),
    ("AssetsCurrent", "balance_sheet", "current_assets"),
    ("Liabilities", "balance_sheet", "total_liabilities"),
    ("LiabilitiesCurrent", "balance_sheet", "current_liabilities"),
    ("StockholdersEquity", "balance_sheet", "shareholders_equity"),
    ("NetCashProvidedByUsedInOperatingActivities", "cash_flow_statement", "operating_cash_flow"),
    ("PaymentsToAcquirePropertyPlantAndEquipment", "cash_flow_statement", "capital_expenditure"),
)

#: Report section of a concept; any other is UNMAPPED_SECTION.
SECTIONS = {
    "Income statement": ("CostOfRevenue", "GrossProfit", "NetIncomeLoss", "OperatingIncomeLoss", "ResearchAndDevelopmentExpense", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"),
    "Balance sheet": ("Assets", "AssetsCurrent", "CashAndCashEquivalentsAtCarryingValue", "Liabilities", "LiabilitiesCurrent", "MarketableSecuritiesCurrent", "StockholdersEquity"),
    "Cash flow statement": ("NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInOperatingActivities", "PaymentsToAcquirePropertyPlantAndEquipment"),
    "EPS and shares": ("EarningsPerShareBasic",),
    "Other comprehensive income": ("OtherComprehensiveIncomeLossNetOfTax",),
}
UNMAPPED_SECTION = "Unmapped financial facts"
