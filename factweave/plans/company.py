"""One company from its ticker to the stored tables and back out, with the source on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import companies, filings, inventory, metrics, normalize
from ..sources import files
from ..sources.http import Client, SourceError, land
from ..sources.tables import KeyedTable
from . import ingest as plan
from .staging import scratch

# --- fixed values: where the source keeps its documents, and the wording of messages

TICKERS_URL = "https://www.sec.gov/files/company_tickers.json"
SUBMISSIONS_URL = "https://data.sec.gov/submissions/CIK{cik}.json"
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK{cik}.json"
FLAG_WARNING = "Normalized facts include quality flag: {}"
MISSING_WARNING = "Active-window accessions missing from SEC recent filings: {}"
CLEANUP_WARNING = "Skipped inactive filing evidence cleanup for {} local paths"
FAILED_WARNING = "SEC refresh failed; using existing local data: {}"
DELETED = "Deleted ingested company for {}"
NOT_FOUND = "No ingested company found for {}."
NOT_REMOVED = ", but some filing artifacts could not be removed"


class Warehouse:
    """The stored tables of all companies below one folder."""

    def __init__(self, spark: SparkSession, path: str, **options):
        at = lambda name, ddl, keys: KeyedTable(spark, f"{path.rstrip('/')}/{name}", ddl, keys, deal_by="cik", **options)
        self.spark = spark
        self.facts = at("facts", schema.FACTS, ["unique_key"])
        self.filings = at("filings", schema.FILINGS, ["accession_number"])
        self.metrics = at("metrics", schema.METRICS, ["metric_id"])
        self.indicators = at("indicators", schema.INDICATORS, schema.INDICATOR_KEY)
        self.companies = at("companies", schema.COMPANIES, ["cik"])

    def of(self, cik: str) -> dict[str, DataFrame]:
        """What is stored of one company."""
        return {n: getattr(self, n).read_of(cik) for n in ("facts", "filings", "metrics", "companies")}

    def company(self, identifier: str) -> Row | None:
        return companies.find_company(self.companies.read(), identifier)


@dataclass(frozen=True)
class CompanyIngestion:
    """What became of one ticker."""

    ticker: str
    cik: str
    status: str
    sec_checked: bool
    refresh_due_10k: bool
    refresh_due_10q: bool
    filings: tuple[Row, ...] = ()
    local_paths: tuple[str | None, ...] = ()
    normalized_fact_count: int = 0
    stored_fact_count: int = 0
    stored_filing_count: int = 0
    stored_metric_count: int = 0
    active_metric_count: int = 0
    warnings: tuple[str, ...] = ()


@dataclass(frozen=True)
class CompanyDeletion:
    """What was deleted for one identifier."""

    identifier: str
    cik: str | None
    company_found: bool
    message: str
    deleted: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("metrics", "filings", "facts", "companies"), 0))
    paths_deleted: tuple[str, ...] = ()
    paths_skipped: tuple[str, ...] = ()


def fetch_documents(client: Client, spark: SparkSession, ticker: str) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """(cik, ticker map, submissions, company facts) of a ticker, landed."""
    tickers = land(spark, [client.get_json(TICKERS_URL)])
    cik = normalize.resolve_ticker(normalize.ticker_map(tickers), ticker)
    return cik, tickers, land(spark, [client.get_json(SUBMISSIONS_URL.format(cik=cik))]), land(spark, [client.get_json(FACTS_URL.format(cik=cik))])


def ingest_company(
    ticker: str, warehouse: Warehouse, client: Callable[[], Client], as_of: str, *, filings_dir: str | Path | None = None
) -> CompanyIngestion:
    """Fetch, normalise and store a ticker's company if it is unknown or due.

    A known company that isn't due is not asked for; one whose refresh fails is told from what is stored. ``client`` is
    made only if it is needed. Filing documents are kept below ``filings_dir`` if there is one.
    """
    name = ticker.strip().upper()
    if not name:
        raise ValueError("a ticker is needed")
    known = warehouse.company(name)
    if known is not None and not any(_due(known, as_of)):
        return _local(warehouse, known, as_of, "reused_local", False)
    try:
        try:
            with scratch(warehouse.spark):
                return _refresh(name, warehouse, client(), as_of, known, filings_dir)
        except PySparkException as e:  # structural damage ends a job
            raise SourceError(str(e).splitlines()[0]) from e
    except SourceError as e:
        if known is None:
            raise
        return _local(warehouse, known, as_of, "refresh_failed_using_local_data", True, (FAILED_WARNING.format(e),))


def _due(company: Row, as_of: str) -> tuple[bool, bool]:
    dates = (company.next_check_date_10k, company.next_check_date_10q)
    return tuple(d is None or as_of >= d.isoformat() for d in dates)


def _local(warehouse: Warehouse, company: Row, as_of: str, status: str, checked: bool, warnings: tuple[str, ...] = ()) -> CompanyIngestion:
    of = warehouse.of(company.cik)
    held = filings.list_filings(of["filings"], company.cik, forms=schema.SUPPORTED_FORMS, active=True).collect()
    n, active = of["metrics"].agg(F.count("*"), F.count_if("is_active_window")).first()
    return CompanyIngestion(
        company.ticker or "", company.cik, status, checked, *_due(company, as_of), filings=tuple(held), local_paths=tuple(f.local_path for f in held),
        stored_filing_count=len(held), stored_metric_count=n, active_metric_count=active, warnings=warnings,
    )


def _refresh(name: str, warehouse: Warehouse, client: Client, as_of: str, known: Row | None, filings_dir: str | Path | None) -> CompanyIngestion:
    cik, tickers, submissions, companyfacts = fetch_documents(client, warehouse.spark, name)
    tables = warehouse.of(cik)
    known = known or tables["companies"].first()
    recorded = {r.accession_number: r.local_path for r in tables["filings"].select("accession_number", "local_path").collect()}

    def local_copy(f: Row) -> str | None:
        if filings_dir is None:
            return recorded.get(f.accession_number)
        kept = recorded.get(f.accession_number)
        if kept and Path(kept).exists():
            return kept
        return str(files.download(filings_dir, cik, f.accession_number, f.document, lambda: client.get(f.document_url))[0])

    made = plan.ingest(companyfacts, submissions, tickers, tables, as_of, local_copy=local_copy)
    told = made.summary.first()
    owner = warehouse.spark.createDataFrame([(cik,)], "cik string")
    # the company comes last: what stops before it is ingested anew
    for table in ("facts", "filings", "metrics", "companies"):
        getattr(warehouse, table).put(getattr(made, table).filter(F.col("cik") == cik), owner)
    warnings = [FLAG_WARNING.format(f) for f in told.warnings or ()]
    if told.missing_filings:
        warnings.append(MISSING_WARNING.format(told.missing_filings))
    held = filings.list_filings(warehouse.of(cik)["filings"], cik).collect()
    if filings_dir is not None:
        stale = [f.local_path for f in held if f.local_path and not f.is_active_window and Path(f.local_path).exists()]
        if problems := files.remove_filings(filings_dir, stale):
            warnings.append(CLEANUP_WARNING.format(len(problems)))
    chosen = sorted(made.selected.collect(), key=lambda f: (f.filing_date, f.accession_number))
    paths = {f.accession_number: f.local_path for f in held}
    due = _due(known or warehouse.company(cik), as_of)
    return CompanyIngestion(
        name, cik, told.status, True, *due, filings=tuple(chosen), local_paths=tuple(paths.get(f.accession_number) for f in chosen),
        normalized_fact_count=told.n_normalized, stored_fact_count=told.n_normalized, stored_filing_count=told.n_filings, stored_metric_count=told.n_metrics,
        active_metric_count=told.n_active_metrics, warnings=tuple(warnings),
    )


def delete_ingested_company(identifier: str, warehouse: Warehouse, *, filings_dir: str | Path | None = None) -> CompanyDeletion:
    """Delete what is stored of a ticker or CIK, and its filing files; an unknown company deletes nothing."""
    name = identifier.strip().upper()
    if not name:
        raise ValueError("an identifier is needed")
    company = warehouse.company(name)
    cik = company.cik if company is not None else companies.cik_of(name)
    label = f"identifier '{name}'" + (f" (CIK {cik})" if cik is not None and (company is not None or cik != name) else "")
    if company is None:
        return CompanyDeletion(name, cik, False, NOT_FOUND.format(label))
    recorded = [r[0] for r in warehouse.of(cik)["filings"].filter("local_path is not null").select("local_path").collect()]
    owner = warehouse.spark.createDataFrame([(cik,)], "cik string")
    deleted = {t: getattr(warehouse, t).delete(owner) for t in ("metrics", "filings", "facts", "companies")}
    warehouse.indicators.delete(owner)
    gone, skipped = _remove(filings_dir, cik, recorded) if filings_dir is not None else ([], [])
    message = DELETED.format(label) + NOT_REMOVED * bool(skipped) + "."
    return CompanyDeletion(name, cik, True, message, deleted, tuple(gone), tuple(skipped))


def _remove(base: str | Path, cik: str, recorded: list[str]) -> tuple[list[str], list[str]]:
    there = list(dict.fromkeys(str(Path(p).resolve()) for p in (Path(base) / cik, *recorded) if Path(p).exists()))
    problems = files.remove_filings(base, there)
    skipped = [p for p in there if any(x.startswith(f"{p}: ") for x in problems)]
    return [p for p in there if p not in skipped and not Path(p).exists()], skipped


# --- the routes of the service, as functions that give tables ----------------------------------------------


def route_metrics(warehouse: Warehouse, cik: str, **options) -> DataFrame:
    return metrics.list_metrics(warehouse.metrics.read_of(cik), cik, **options)


def route_indicators(warehouse: Warehouse, cik: str) -> DataFrame:
    """The company's indicators, calculated from its stored metrics and stored."""
    from ..operators import indicators

    made = indicators.calculate(warehouse.metrics.read_of(cik))
    warehouse.indicators.merge(indicators.numbered(made), order="batch_pos")
    return indicators.list_indicators(warehouse.indicators.read_of(cik), cik)


def route_analytics(warehouse: Warehouse, cik: str) -> DataFrame:
    from ..operators import analytics

    return analytics.trends(analytics.metric_series(warehouse.metrics.read_of(cik)))


def route_facts_csv(warehouse: Warehouse, cik: str, path: str) -> list[str]:
    return inventory.export_csv(metrics.list_facts(warehouse.facts.read_of(cik), cik), path, ["concept", "end_date", "accession_number", "unit"])


def route_indicators_csv(warehouse: Warehouse, cik: str, path: str) -> list[str]:
    return inventory.export_csv(warehouse.indicators.read_of(cik), path, list(schema.INDICATOR_KEY))


def route_analyze(warehouse: Warehouse, cik: str) -> DataFrame:
    """(section, line) of what there is to say about a company without a model."""
    from ..operators import evidence

    return evidence.answer_sections({"metrics": route_metrics(warehouse, cik), "trends": route_analytics(warehouse, cik), "evidence": evidence.inventory(warehouse.of(cik))})


def route_ask(warehouse: Warehouse, chunks: DataFrame, questions: DataFrame, *, k: int = 5, minimum: float = 0.0) -> DataFrame:
    """Passages for questions (query_id, text), weak answers marked; no model is called."""
    from ..operators import retrieval

    found = retrieval.lexical_topk(chunks, questions, id_col="id", text_col="chunk", query_id="query_id", query_text="text", k=k)
    return found.join(retrieval.flag_weak(found, questions, query_id="query_id", minimum=minimum).select("query_id", "is_weak"), "query_id", "right")
