"""The names that users of the engine need, in one place."""

from .functions.calendar import due_date, is_business_day, next_business_day, next_check_date, previous_business_day
from .operators.analytics import compare_periods, gaps, margin_steps, metric_series, outliers, trends
from .operators.companies import due_companies, find_company, lookup
from .operators.filings import list_filings, select_active
from .operators.indicators import calculate as calculate_indicators
from .operators.indicators import list_indicators
from .operators.inventory import export_csv, export_tables
from .operators.metrics import base_metrics, list_facts, list_metrics, trace
from .operators.normalize import normalize_companyfacts, recent_filings, resolve_ticker, ticker_map
from .operators.periods import active_accessions, active_period_keys
from .plans.company import CompanyDeletion, CompanyIngestion, Warehouse, delete_ingested_company, ingest_company
from .plans.report import ingestion_report
from .sources.files import download, filing_path, remove_filings
from .sources.http import Client, SavedClient, SourceError, TickerNotFound
from .sources.settings import Settings, load_settings
from .sources.tables import KeyedTable

__all__ = [n for n in dir() if not n.startswith("_")]
