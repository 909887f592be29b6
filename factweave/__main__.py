"""python -m factweave TICKER: ingest a company if it is unknown or due, and report on it; --delete takes it out."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Client, Warehouse, delete_ingested_company, export_tables, ingest_company, ingestion_report, load_settings


def main(argv: Sequence[str] | None = None, *, spark: SparkSession | None = None, client: Callable[[], Client] | None = None) -> str:
    """What is printed. ``spark`` and ``client`` take the place of those that the settings give."""
    parser = argparse.ArgumentParser(prog="factweave", description=__doc__)
    parser.add_argument("ticker", help="a ticker, or a CIK that is stored")
    parser.add_argument("--env-file", default=".env")
    parser.add_argument("--warehouse", help="folder of the stored tables")
    parser.add_argument("--filings-dir", help="folder of the filings' copies")
    parser.add_argument("--as-of", default=dt.date.today().isoformat(), help="the day that counts as today")
    parser.add_argument("--export", help="folder for the tables as CSV")
    parser.add_argument("--delete", action="store_true")
    given = parser.parse_args(argv)
    settings = load_settings(given.env_file)
    spark = spark or SparkSession.builder.appName("factweave").getOrCreate()
    store, base = Warehouse(spark, given.warehouse or settings.warehouse), given.filings_dir or settings.filings_dir
    if given.delete:
        text = delete_ingested_company(given.ticker, store, filings_dir=base).message
    else:
        result = ingest_company(given.ticker, store, client or (lambda: Client(settings.user_agent)), given.as_of, filings_dir=base)
        of = store.of(result.cik)
        text = ingestion_report(of["facts"], of["metrics"], of["filings"].filter(F.col("cik") == result.cik), result)
        if given.export:
            text = "\n".join([text, *export_tables(of["companies"], of["filings"], of["facts"], of["metrics"], given.export)])
    print(text)
    return text


if __name__ == "__main__":
    main()
