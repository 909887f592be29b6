from __future__ import annotations

import datetime as dt
import functools
import gzip
import io
import json
import math
import operator
import random
import tracemalloc
import urllib.error
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factweave import catalog, schema
from factweave.functions import calendar as C
from factweave.functions import scalars as S
from factweave.operators import analytics, evidence, filings, indicators, inventory, merge, metrics, normalize, periods, retrieval
from factweave.plans import company, ingest, report
from factweave.sources import files, http, tables
from factweave.sources import settings as conf
from factweave.streaming import facts as stream

SF = "/root/testdata/sf0.001"


def entry(val, fy, fp, form, accn, start=None, end=None, filed="2025-11-01", **more):
    return {"val": val, "fy": fy, "fp": fp, "form": form, "accn": accn, "start": start, "end": end, "filed": filed, **more}


YEAR = entry(1000, 2025, "FY", "10-K", "0000000042-25-000003", "2024-10-01", "2025-09-27", "2025-10-31")
FACTS = {
    "cik": 42, "entityName": "Example Corp",
    "facts": {"us-gaap": {
        "Revenues": {"label": "Revenue", "description": None, "units": {"USD": [YEAR, YEAR, entry("77120450000.25", 2025, "Q3", "10-Q", "0000000042-25-000002", "2025-04-01", "2025-06-28", "2025-07-31"), entry(5, 2025, "Q1", "8-K", "0000000042-25-000001", "2025-01-01", "2025-03-29")]}},
        "Assets": {"label": "Assets", "description": None, "units": {"USD": [entry(7, 2025, "FY", "10-K", "0000000042-25-000003", None, "2025-09-27")], "EUR": [entry(6, 2025, "FY", "10-K", "0000000042-25-000003", None, "2025-09-27")]}},
    }},
}
SUBMISSIONS = {
    "cik": "42", "name": "Example Corporation", "tickers": ["exm"], "exchanges": ["NYSE"], "sic": "3571", "sicDescription": "Computers",
    "filings": {"recent": {"accessionNumber": ["0000000042-25-000003", "0000000042-25-000002", "0000000042-25-000001"], "filingDate": ["2025-10-31", "2025-07-31", "2025-05-01"], "form": ["10-K", "10-q", "8-K"], "primaryDocument": ["k.htm", "q.htm", "e.htm"]}},
}
TICKERS = {"0": {"cik_str": 42, "ticker": "exm ", "title": "EXAMPLE"}, "1": {"cik_str": 7, "ticker": "OLD", "title": "Old"}, "2": {"cik_str": 8, "ticker": "old", "title": "New"}}


@pytest.fixture
def docs(spark):
    return lambda d: http.land(spark, [d])


# --- normalisation ------------------------------------------------------------------------------------


def test_golden_document(docs):
    rows = normalize.normalize_companyfacts(docs(FACTS)).collect()
    got = Counter((r.concept, r.unit, r.form, tuple(r.quality_flags)) for r in rows)
    assert got == {
        ("Revenues", "USD", "10-K", ("duplicate_fact",)): 2, ("Revenues", "USD", "10-Q", ()): 1, ("Revenues", "USD", "8-K", ("unsupported_form",)): 1,
        ("Assets", "USD", "10-K", ("ambiguous_unit",)): 1, ("Assets", "EUR", "10-K", ("ambiguous_unit",)): 1,
    }
    assert len({r.unique_key for r in rows}) == 5 and {r.cik for r in rows} == {"0000000042"}
    assert {r.value for r in rows if r.form == "10-Q"} == {Decimal("77120450000.2500000000")}


def test_filters(docs):
    assert normalize.normalize_companyfacts(docs(FACTS), forms=["10-k", "10-Q"]).count() == 5
    assert normalize.normalize_companyfacts(docs(FACTS), concepts=["Assets"]).filter("array_contains(quality_flags, 'ambiguous_unit')").count() == 2
    assert normalize.normalize_companyfacts(docs(FACTS), taxonomies=["dei"]).count() == 0


def test_malformed_values_are_flagged(docs):
    bad = [entry("not-a-number", "2025.0", "FY", "10-K", "a", "x", "2025-01-31"), entry(None, 2025, "FY", None, " ", "2025-03-01", "2025-01-31"), entry(1, 2025, "FY", "10-K/A", "a", None, "", "2025-9-7"), entry("NaN", 1, "FY", "10-K", "b", None, "20250101")]
    d = {"cik": "1", "facts": {"us-gaap": {"X": {"units": {"USD": bad}}}}}
    got = [r.quality_flags for r in normalize.normalize_companyfacts(docs(d)).orderBy("pos").collect()]
    assert got == [
        ["non_numeric_value", "invalid_date"], ["missing_value", "inconsistent_period", "missing_form", "missing_accession_number"],
        ["missing_end_date", "invalid_date", "unsupported_form"], ["non_numeric_value", "missing_end_date", "invalid_date"],
    ]


@pytest.mark.parametrize("d", [{"cik": "x1", "facts": {}}, {"cik": "12345678901", "facts": {}}, {"cik": 1}, {"cik": 1, "facts": {"us-gaap": {"X": {"label": "x"}}}}])
def test_structural_damage_raises(docs, d):
    with pytest.raises(Exception, match="without"):
        normalize.normalize_companyfacts(docs(d)).collect()


def test_tickers(docs):
    got = {r.ticker: (r.cik, r.title) for r in normalize.ticker_map(docs(TICKERS)).collect()}
    assert got == {"EXM": ("0000000042", "EXAMPLE"), "OLD": ("0000000008", "New")}
    assert normalize.resolve_ticker(normalize.ticker_map(docs(TICKERS)), " exm") == "0000000042"
    with pytest.raises(LookupError):
        normalize.resolve_ticker(normalize.ticker_map(docs(TICKERS)), "none")


def test_recent_filings(docs):
    got = {r.form_type: r for r in normalize.recent_filings(docs(SUBMISSIONS)).collect()}
    assert set(got) == {"10-K", "10-Q"}
    assert got["10-K"].document_url == "https://www.sec.gov/Archives/edgar/data/42/000000004225000003/k.htm"
    uneven = json.loads(json.dumps(SUBMISSIONS))
    uneven["filings"]["recent"]["form"].pop()
    with pytest.raises(Exception, match="differ in length"):
        normalize.recent_filings(docs(uneven)).collect()


# --- ingestion ----------------------------------------------------------------------------------------


def test_ingest_end_to_end(spark, docs):
    first = ingest.ingest(docs(FACTS), docs(SUBMISSIONS), docs(TICKERS), ingest.empty_tables(spark), "2025-11-03")
    s = first.summary.collect()[0]
    assert (s.status, s.n_normalized, s.n_facts, s.n_metrics, s.n_active_metrics, s.n_new) == ("initialized", 6, 5, 1, 1, 2)
    assert s.warnings == ["ambiguous_unit", "duplicate_fact", "unsupported_form"]
    c = first.companies.collect()[0]
    assert (c.name, c.ticker, c.exchange) == ("Example Corp", "EXM", "NYSE")
    assert (c.next_check_date_10k, c.next_check_date_10q) == (dt.date(2026, 10, 30), dt.date(2026, 1, 30))
    m = first.metrics.collect()[0]
    assert (m.metric_name, m.fiscal_year, m.fiscal_period, m.value) == ("revenue", 2025, "Q3", Decimal("77120450000.2500000000"))
    tables = {n: getattr(first, n).cache() for n in ("facts", "filings", "metrics", "companies")}
    assert not ingest.needs_refresh(tables, "exm", "2026-01-29") and ingest.needs_refresh(tables, "42", "2026-01-30") and ingest.needs_refresh(tables, "zzz", "2026-01-29")
    again = ingest.ingest(docs(FACTS), docs(SUBMISSIONS), docs(TICKERS), tables, "2026-02-02")
    assert again.facts.count() == 5 and again.filings.count() == 2 and again.metrics.count() == 1
    assert again.summary.collect()[0].status == "checked_no_update"
    c2 = again.companies.collect()[0]
    assert c2.next_check_date_10q == dt.date(2026, 2, 3) and c2.next_check_date_10k == c.next_check_date_10k and c2.created_at == c.created_at
    text = report.ingestion_report(first.facts, first.metrics, first.filings)
    for line in ("- Income statement: 1 concept, 3 stored facts", "  - us-gaap:Assets: 2 facts; units: EUR, USD; periods: FY2025", "- Income Statement: 1 metric name, 1 metric value", "- 10-Q XBRL quarterly periods in storage: 1 fiscal quarter: FY2025 Q3"):
        assert line in text.splitlines()
    assert "(4 stored XBRL facts, periods: FY2025): file: not downloaded; concepts: us-gaap:Assets [EUR] (1 fact), us-gaap:Assets [USD] (1 fact), us-gaap:Revenues [USD] (1 fact)" not in text
    assert "- 10-K 2025-10-31 0000000042-25-000003 (3 stored XBRL facts, periods: FY2025): file: not downloaded; concepts: us-gaap:Assets [EUR] (1 fact), us-gaap:Assets [USD] (1 fact), us-gaap:Revenues [USD] (1 fact)" in text
    assert report.markdown_table(inventory.table_counts({"a|b": first.facts}))[2] == "| a/b | 5 |"
    assert ingest.health() == {"status": "ok"}


def test_active_window_bounds(spark):
    rows = [("1", "10-K", y, "FY") for y in range(2018, 2026)] + [("1", "10-q", y, f"q{q}") for y in range(2021, 2025) for q in range(1, 5)] + [("1", "10-K", 2030, "Q1"), ("1", "8-K", 2031, "FY"), ("1", "10-K", None, "FY")]
    keys = {(r.form, r.fiscal_year, r.fiscal_period) for r in periods.active_period_keys(spark.createDataFrame(rows, "cik string, form string, fiscal_year int, fiscal_period string")).collect()}
    assert keys == {("10-K", y, "FY") for y in range(2021, 2026)} | {("10-Q", y, f"Q{q}") for y in range(2022, 2025) for q in range(1, 5)}


def test_fallback_selection_and_period_summary(spark):
    f = spark.createDataFrame([("1", "a", "10-K", dt.date(2020, 1, 1), 0), ("1", "b", "10-K", dt.date(2021, 1, 1), 1), ("1", "c", "10-Q", dt.date(2021, 1, 1), 2), ("1", "d", "10-Q", dt.date(2021, 1, 1), 3)], "cik string, accession_number string, form_type string, filing_date date, pos int")
    none = spark.createDataFrame([], "cik string, accession_number string")
    assert {r.accession_number for r in filings.select_active(f, none).collect()} == {"b", "c"}
    facts = spark.createDataFrame([("1", "a", "10-K", 2020, "FY", dt.date(2020, 9, 1)), ("1", "a", "10-K", 2020, "FY", None), ("1", "a", "10-K", 2020, "Q4", dt.date(2021, 9, 1)), ("1", "a", "10-K", 2019, "FY", dt.date(2022, 1, 1))], "cik string, accession_number string, form string, fiscal_year int, fiscal_period string, end_date date")
    r = filings.period_summary(facts).collect()
    assert [(x.fiscal_year, x.fiscal_period, x.report_date) for x in r] == [(2020, "FY", dt.date(2020, 9, 1))]
    with pytest.raises(LookupError, match="10-Q"):
        filings.require_forms(f.filter("form_type = '10-K'"))


# --- scalars and calendar -----------------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = lambda x: F.lit(x).cast("string")
    assert [one(spark, S.normalize_cik(lit(x))) for x in (" 42 ", "12345678901", "4a", None)] == ["0000000042", None, None, None]
    assert [one(spark, S.parse_int(lit(x))) for x in ("2025", "2025.0", "", " 7 ")] == [2025, None, None, 7]
    assert [one(spark, S.period_label(F.lit(y).cast("int"), lit(p), lit("end"))) for y, p in ((2025, "FY"), (2026, "q2"), (None, None), (2024, None))] == ["FY2025", "FY2026 Q2", "end", "FY2024"]
    assert one(spark, S.cell(lit("a|b\nc" + "x" * 200))) == "a/b c" + "x" * 112 + "..."
    assert one(spark, S.title(lit("operating_cash_flow"))) == "Operating Cash Flow"
    assert [one(spark, S.safe_name(lit(x))) for x in ("a.htm", "../a", "a/b", " ")] == [True, False, False, False]
    assert one(spark, S.shortened(F.array(*(F.lit(str(k)) for k in range(7))))) == "0, 1, 2, 3, 4 (+2 more)"


def test_golden_business_days(spark):
    day = lambda x: F.lit(x).cast("date")
    assert one(spark, C.previous_business_day(day("2026-07-04"))) == dt.date(2026, 7, 2)
    assert one(spark, C.previous_business_day(day("2026-04-03"))) == dt.date(2026, 4, 2)
    assert one(spark, C.next_business_day(day("2026-07-04"))) == dt.date(2026, 7, 6)
    assert one(spark, C.next_business_day(day("2026-12-25"))) == dt.date(2026, 12, 28)
    assert one(spark, C.next_check_date(F.lit("10-K"), day("2025-07-03"), F.lit("FY"))) == dt.date(2026, 7, 2)
    assert one(spark, C.next_check_date(F.lit("10-Q"), day("2025-12-25"), F.lit("Q1"))) == dt.date(2026, 3, 25)
    assert one(spark, C.next_check_date(F.lit(None).cast("string"), day("2025-12-25"), F.lit("Q1"))) is None
    with pytest.raises(Exception, match="no refresh rule"):
        one(spark, C.next_check_date(F.lit("8-K"), day("2025-12-25"), F.lit("Q1")))
    assert one(spark, C.is_business_day(day("2021-12-31"))) is False


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1900, 2199), min_size=1, max_size=50, unique=True))
def test_easter_is_a_spring_sunday(spark, years):
    rows = spark.createDataFrame([(y,) for y in years], "y int").select(C.easter(F.col("y")).alias("e")).collect()
    known = {2024: (3, 31), 2025: (4, 20), 2026: (4, 5), 2000: (4, 23), 1961: (4, 2), 2038: (4, 25)}
    for r in rows:
        assert r.e.weekday() == 6 and dt.date(r.e.year, 3, 22) <= r.e <= dt.date(r.e.year, 4, 25)
        assert r.e.year not in known or (r.e.month, r.e.day) == known[r.e.year]


# --- merges and streaming -----------------------------------------------------------------------------


def test_merge(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "n", "y")], "k int, v string, kept string")
    new = spark.createDataFrame([(2, "c", "new", 1), (2, "d", "newer", 2), (3, "e", "z", 1), (None, "m", "q", 1)], "k int, v string, kept string, s int")
    got = {r.k: (r.v, r.kept) for r in merge.upsert(old, new, ["k"], order="s", keep_first=["kept"]).collect()}
    assert got == {1: ("a", "x"), 2: ("d", None), 3: ("e", "z"), None: ("m", "y")}
    with pytest.raises(ValueError, match="no column"):
        merge.upsert(old, new, ["k"], order="pos")
    left, counts = merge.cascade_delete({"a": old.withColumn("cik", F.col("v"))}, spark.createDataFrame([("a",), ("zz",)], "cik string"))
    assert left["a"].count() == 2 and counts.first().n_deleted == 1


class Stop(Exception):
    pass


def test_a_stored_table_survives_a_stop_at_any_step(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, n int")
    for step in ("_publish", "_clean"):
        table = tables.KeyedTable(spark, str(tmp_path / step), "k int, v string", ["k"], deal_by="k", buckets=4)
        assert table.read().count() == 0
        table.merge(rows(*((k, "old", 0) for k in range(20))), order="n")
        with monkeypatch.context() as m:
            m.setattr(table, step, lambda *a, **b: (_ for _ in ()).throw(Stop()))
            with pytest.raises(Stop):
                table.merge(rows((1, "lost", 2), (1, "new", 3), (1, "late", 1), (50, "more", 1)), order="n")
        got = dict(map(tuple, table.read().collect()))
        assert got == {k: "old" for k in range(20)} | ({1: "new", 50: "more"} if step == "_clean" else {})
        # a manifest that was being written
        part = tmp_path / step / "manifests" / f"{99:012d}.part"
        part.write_text("{")
        table.merge(rows((2, "again", 0)), order="n")
        table.merge(rows((3, "again", 0)), order="n")
        got = dict(map(tuple, table.read().collect()))
        assert got == {k: "old" for k in range(20)} | ({1: "new", 50: "more"} if step == "_clean" else {}) | {2: "again", 3: "again"}
        assert not part.exists() and len(list((tmp_path / step / "manifests").glob("*.json"))) == 2
        named = {f for m in table._versions() for f in table._load(m).values()}
        assert {p.name for p in (tmp_path / step / "data").iterdir()} == named
    assert table.delete(spark.createDataFrame([(3,), (77,)], "k int")) == 1 and table.read().count() == 20


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), "k int, v string", ["k"], deal_by="k", buckets=8)
    table.put(spark.range(100).selectExpr("cast(id as int) k", "'a' v"), spark.range(100).selectExpr("cast(id as int) k"))
    before = table._manifest()[1]
    table.merge(spark.createDataFrame([(5, "b", 1)], "k int, v string, n int"), order="n")
    after = table._manifest()[1]
    assert [r.v for r in table.read_of(5).collect()] == ["b"] and len(table.read_of(5).inputFiles()) == 1 and table.read_of(1000).count() == 0
    assert sum(before[b] != after[b] for b in before) == 1 and table.read().filter("v = 'b'").count() == 1 and table.read().count() == 100


def test_stream_merges_by_key(spark, docs, tmp_path):
    table, inbox = stream.fact_table(spark, str(tmp_path / "facts")), str(tmp_path / "in")
    batch = normalize.normalize_companyfacts(docs(FACTS)).withColumn("batch_pos", F.col("pos").cast("long")).withColumn("created_at", F.lit("2025-11-03").cast("timestamp")).select(*spark.createDataFrame([], schema.FACTS).columns)
    for n in (1, 2):
        batch.withColumn("entity_name", F.lit(f"v{n}")).write.mode("append").parquet(inbox)
        q = stream.merge_stream(stream.fact_stream(spark, inbox), table, str(tmp_path / "ck"))
        q.awaitTermination()
        got = table.read()
        assert got.count() == 5 and {r.entity_name for r in got.collect()} == {f"v{n}"}


# --- indicators, analytics, retrieval, evidence ---------------------------------------------------------


def metric(name, fy, fp, value, unit="USD", kind="duration", start="2025-01-01", end="2025-03-31", n=0):
    d = lambda x: None if x is None else dt.date.fromisoformat(x)
    return (f"{name}{fy}{fp}{n}", "1", f"acc{fy}{fp}", f"raw{n}", "s", name, None if value is None else Decimal(value), None, unit, kind, fy, fp, d(start), d(end), d(end), True, None, None, None)


def test_indicator_reasons(spark):
    rows = [
        metric("revenue", 2023, "FY", -100), metric("revenue", 2024, "FY", 100), metric("revenue", 2026, "FY", 50), metric("revenue", 2024, "Q4", 0), metric("revenue", 2025, "Q1", 9),
        metric("gross_profit", 2024, "FY", 40), metric("gross_profit", 2024, "Q4", 4), metric("net_income", 2024, "FY", 5, unit="EUR"), metric("net_income", 2026, "FY", 1), metric("net_income", 2026, "FY", 2, n=1),
        metric("operating_cash_flow", 2024, "FY", 30), metric("capital_expenditure", 2024, "FY", -10), metric("total_assets", 2024, "FY", 10, kind="instant", start=None), metric("total_liabilities", 2024, "FY", 5),
    ]
    out = indicators.calculate(spark.createDataFrame(rows, schema.METRICS))
    got = {(r.indicator_name, r.fiscal_year, r.fiscal_period): (None if r.value is None else float(r.value), r.skip_reason) for r in out.collect()}
    assert got["revenue_growth", 2024, "FY"] == (2.0, None) and got["revenue_growth", 2023, "FY"] == (None, "missing_prior_period")
    assert got["revenue_growth", 2026, "FY"] == (None, "missing_prior_period") and got["revenue_growth", 2025, "Q1"] == (None, "zero_prior_period")
    assert got["gross_margin", 2024, "FY"] == (0.4, None) and got["gross_margin", 2024, "Q4"] == (None, "zero_denominator") and got["gross_margin", 2026, "FY"] == (None, "missing_required_metric")
    assert got["net_margin", 2024, "FY"] == (None, "unit_mismatch") and got["net_margin", 2026, "FY"] == (None, "ambiguous_metric_set")
    assert got["free_cash_flow", 2024, "FY"] == (20.0, None) and got["debt_ratio", 2024, "FY"] == (None, "period_type_mismatch")
    traced = out.filter("indicator_name = 'gross_margin' and fiscal_year = 2024 and fiscal_period = 'FY'").first()
    assert traced.source_metric_ids == ["gross_profit2024FY0", "revenue2024FY0"] and traced.source_accession_numbers == ["acc2024FY"] and traced.formula_version == "v1"
    wrote = merge.upsert(out, indicators.numbered(out), schema.INDICATOR_KEY, order="batch_pos")
    assert wrote.count() == out.count() == 5 * 8


def test_trends_gaps_outliers(spark):
    rows = [("1", "s", y, "FY", Decimal(v)) for y, v in ((2019, 10), (2020, 11), (2021, 10), (2022, 9), (2023, 10), (2025, 90))] + [("2", "s", 2020, "FY", Decimal(1))]
    series = spark.createDataFrame(rows, "cik string, series string, fiscal_year int, fiscal_period string, value decimal(38,10)")
    t = {r.cik: r for r in analytics.trends(series).collect()}
    assert (t["1"].direction, t["1"].n_periods, t["1"].change_from_prior, t["2"].direction) == ("up", 6, None, "single_period")
    assert [(r.fiscal_year, r.n_missing) for r in analytics.gaps(series).collect()] == [(2025, 1)]
    assert [r.fiscal_year for r in analytics.outliers(series).collect()] == [2025]
    assert {(r.benchmark_status, r.reason) for r in analytics.benchmark_status(series).collect()} == {("refused", "no benchmark data")}


def test_retrieval_and_evidence(spark):
    docs = spark.createDataFrame([(1, "Revenue grew. Costs fell!"), (2, "Nothing to see"), (3, None), (4, "")], "id int, text string")
    assert [r.sentence for r in retrieval.sentences(docs, id_col="id", text_col="text").filter("id = 1").orderBy("sentence_no").collect()] == ["Revenue grew.", "Costs fell!"]
    q = spark.createDataFrame([(1, "revenue costs"), (2, "absent")], "qid int, q string")
    found = retrieval.lexical_topk(docs, q, id_col="id", text_col="text", query_id="qid", query_text="q")
    assert [(r.query_id, r.rank, r.id) for r in found.collect()] == [(1, 1, 1)]
    weak = {r.query_id: r.is_weak for r in retrieval.flag_weak(found, q, query_id="qid", minimum=0.5).collect()}
    assert weak == {1: False, 2: True}
    assert one(spark, retrieval.html_text(F.lit("<p>A &amp; B<script>x</script>\n c</p>"))) == "A & B c"
    claims = spark.createDataFrame([(1, ["a"]), (2, ["a", "zz"]), (3, [])], "claim_id int, evidence_ids array<string>")
    got = {r.claim_id: r.is_supported for r in evidence.unsupported_claims(claims, spark.createDataFrame([("a",)], "evidence_id string")).collect()}
    assert got == {1: True, 2: False, 3: False}


# --- sources --------------------------------------------------------------------------------------------


class Answer(io.BytesIO):
    headers = {"Content-Encoding": "gzip"}


def test_client_retries_and_waits():
    slept, codes = [], [500, 429]

    def opener(request, timeout):
        if codes:
            raise urllib.error.HTTPError(request.full_url, codes.pop(), "no", {}, None)
        return Answer(gzip.compress(b'{"a": 1}'))

    client = http.Client("me x@y.z", opener=opener, sleep=slept.append, clock=lambda: 0.0)
    assert client.get_json("http://x/") == {"a": 1} and slept == [0.5, 0.1, 1.0, 0.1]
    codes.append(403)
    with pytest.raises(http.SourceError, match="403"):
        client.get("http://x/")
    with pytest.raises(http.SourceError):
        http.Client(" ")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nexport SEC_USER_AGENT='me'\nREPORT_FORMS=[\"10-K\"]\nALLOWED_MODELS=a, b\nMODEL=b\nMODEL_API_KEY=secret\n")
    got = conf.load_settings(tmp_path / ".env", {"MODEL": "a"})
    assert (got.user_agent, got.forms, got.models, got.model) == ("me", ("10-K",), ("a", "b"), "a") and "secret" not in repr(got)
    with pytest.raises(ValueError, match="not among"):
        conf.load_settings(tmp_path / ".env", {"MODEL": "c"})


def test_files(tmp_path):
    path, reused = files.download(tmp_path, "42", "a-1", "k.htm", lambda: b"x")
    assert path.read_bytes() == b"x" and not reused and files.download(tmp_path, "42", "a-1", "k.htm", lambda: b"y") == (path, True)
    with pytest.raises(ValueError):
        files.filing_path(tmp_path, "42", "..", "k.htm")
    assert files.remove_filings(tmp_path, [str(path), str(path), "/etc/hosts"]) == [f"/etc/hosts: outside {tmp_path.resolve()}"] and not (tmp_path / "42").exists()


@pytest.mark.parametrize("block,cells", [(10_000_000, 2_000_000), (400, 50)])
def test_lexical_search_equals_a_plain_form(spark, monkeypatch, block, cells):
    import math
    import random

    monkeypatch.setattr(retrieval, "LEXICAL_BLOCK", block)
    monkeypatch.setattr(retrieval, "_CELLS", cells)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(0, 12))) for _ in range(60)] + [None, "zz", "aa bb", "aa bb", "AA, bb"]
    asked = {k: " ".join(rng.choice("abcdefghijk") * 2 for _ in range(4)) for k in range(12)} | {50: "nowhere", 51: "aa bb"}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    found = retrieval.lexical_topk(docs, spark.createDataFrame(list(asked.items()), "q long, t string"), id_col="id", text_col="text", query_id="q", query_text="t", k=4)
    counts = [Counter((t or "").lower().replace(",", " ").split()) for t in texts]
    idf = {t: math.log(1 + len(texts) / sum(t in c for c in counts)) for c in counts for t in c}
    want = []
    for q, text in asked.items():
        scores = [(-round(sum((1 + math.log(c[t])) * idf[t] * n for t, n in Counter(text.split()).items() if c[t]), 6), i) for i, c in enumerate(counts)]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:4], 1)]
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in found.collect()) == [(q, r, i, round(s, 5)) for q, r, i, s in sorted(want)]


def test_vector_search_takes_any_number_of_queries(spark, monkeypatch):
    many = spark.range(10_001).select((F.col("id") + 100).alias("id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "id long, v array<double>")
    found = retrieval.vector_topk(few, many, id_col="id", vector_col="v", k=2)
    assert found.groupBy("query_id").count().filter("count = 2").count() == 10_001
    best = {r.query_id: r.id for r in found.filter("rank = 1").collect()}
    assert best[100] == 1 and best[110] == 2
    rows = catalog.table(spark, SF, "embeddings")
    asked = rows.filter("vec_id % 20 = 0")
    search = lambda: Counter(map(tuple, retrieval.vector_topk(rows, asked, id_col="vec_id", vector_col="embedding").collect()))
    whole = search()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    assert search() == whole and sum(whole.values()) == 5 * asked.count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vector_search_makes_no_row_for_each_pair(spark):
    plan = plan_of(catalog.QUERIES["vector_topk"](spark, SF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan


def test_weak_results_make_no_row_for_each_pair(spark):
    weak = catalog.QUERIES["weak_results"](spark, SF)
    plan = plan_of(weak)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan
    assert Counter(r.n_results for r in weak.collect()) == {5: 25, 0: 25}


def cosine(a, b):
    """None if there is none; else as Spark's double arithmetic and rounding have it."""
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    total = lambda xs: functools.reduce(operator.add, xs, 0.0)  # noqa: E731  sum() compensates
    under = math.sqrt(total(x * x for x in a)) * math.sqrt(total(x * x for x in b))
    if under == 0:
        return None
    x = total(p * q for p, q in zip(a, b)) / under
    return x if math.isnan(x) else float(Decimal(repr(x)).quantize(Decimal("0.000001"), "ROUND_HALF_UP")) + 0.0


@pytest.mark.parametrize("rows_at_once, cells, per_task, k, kind", [(2048, 2_000_000, 8192, 5, "long"), (3, 10, 8, 4, "long"), (7, 1, 20, 1, "int"), (5, 40, 9, 70, "string")])
def test_vector_search_of_odd_vectors(spark, monkeypatch, rows_at_once, cells, per_task, k, kind):
    for name, value in (("_ROWS", rows_at_once), ("_CELLS", cells), ("ROWS_PER_TASK", per_task)):
        monkeypatch.setattr(retrieval, name, value)
    rng = random.Random(k)
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 3, [-0.0, 0.0, 0.0], [1.0, None, 2.0], [None] * 3, [nan, 1.0, 1.0], [inf, 1.0, 0.0], [1e200, 1.0, -1e200], [1e-200, 0.0, 1e-170], [3e-161, 2e-161, -1e-161], [1e150, -1e150, 2.0], [1.0, 2.0], [2.0, 1.0], [1.0, 2.0, 3.0, 4.0], [-1e-9, 1.0, 0.0], [1.0, 0.0, 0.0]]
    vectors = odd + [[5.0, 5.0, 1.0]] * 12 + [[rng.choice((-2.0, -1.0, 0.0, 1.0, 3.0)) for _ in range(3)] for _ in range(30)]
    rng.shuffle(vectors)
    rows = list(enumerate(vectors)) + [(3, [1.0, 1.0, 1.0]), (3, None), (None, [1.0, 1.0, 1.0])]
    rows = [(None if i is None else str(i) if kind == "string" else i, v) for i, v in rows]
    asked = [r for r in rows if r[0] is None or int(r[0]) % 2 == 1]
    frame = lambda x: spark.createDataFrame(x, f"id {kind}, v array<double>").repartition(2)
    found = retrieval.vector_topk(frame(rows), frame(asked), id_col="id", vector_col="v", k=k)
    want = []
    for q in {i for i, _ in asked if i is not None}:
        scores = [(i, cosine(a, v)) for n, a in asked if n == q for i, v in rows if i is not None and i != q]
        scores.sort(key=lambda x: (x[1] is None, -inf if x[1] is not None and math.isnan(x[1]) else -(x[1] or 0.0), x[0]))
        want += [(q, r, i, str(s)) for r, (i, s) in enumerate(scores[:k], 1)]
    assert sorted((r.query_id, r["rank"], r.id, str(r.score)) for r in found.collect()) == sorted(want)
    assert found.schema["query_id"].dataType.simpleString() == found.schema["id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)


def test_vector_search_scores_few_of_many_copies(monkeypatch):
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(size=(600, 8)), 3)
    v[100:400], v[400:500] = v[0], 0.0
    asked, scored, plain = np.arange(0, 600, 15), [], retrieval._Nearest._cosines
    monkeypatch.setattr(retrieval._Nearest, "_cosines", lambda self, *x: (out := plain(self, *x), scored.append(out.size))[0])
    near = retrieval._Nearest(pa.array(asked), v[asked], 5, 2_000_000)
    near.add(np.arange(600), np.arange(600), v)
    want = []
    for q in asked.tolist():
        scores = [(-(s if (s := cosine(v[q].tolist(), v[i].tolist())) is not None else -9.0), i) for i in range(600) if i != q]
        want += [(q, i, -s if s < 9 else None) for s, i in sorted(scores)[:5]]
    assert [tuple(r.values()) for r in near.rows(pa.int64()).to_pylist()] == want
    assert sum(scored) < 1000  # of 24,000 pairs; the copies alone make 6000, the zeros 8000


def test_vector_search_holds_products_that_fit_a_cache():
    rng = np.random.default_rng(8)
    v, ids = rng.normal(size=(2048, 16)), np.arange(2048)
    near = retrieval._Nearest(pa.array(ids), v, 5, retrieval._CELLS)
    tracemalloc.start()
    near.add(ids, ids, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6


def test_vector_search_of_nothing(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    one = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    for rows, asked in ((none, none), (one, none), (none, one), (one, one)):
        assert retrieval.vector_topk(rows, asked, id_col="id", vector_col="v").collect() == []


def test_cosines_round_as_spark_does(spark):
    x = [0.1234565, 0.1234575, -0.1234565, 0.4999995, 0.3000005, 1.0000000000000002, -1e-9, 4.999999999999999e-7, 5e-7, 1e-300, 123456789.1234565]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert list(map(str, retrieval._rounded(np.array(x)).tolist())) == list(map(str, want))


# --- one company, from its ticker and back -----------------------------------------------------------------

SAVED = {
    company.TICKERS_URL: json.dumps(TICKERS).encode(), company.SUBMISSIONS_URL.format(cik="0000000042"): json.dumps(SUBMISSIONS).encode(), company.FACTS_URL.format(cik="0000000042"): json.dumps(FACTS).encode(),
    "https://www.sec.gov/Archives/edgar/data/42/000000004225000003/k.htm": b"<p>k</p>", "https://www.sec.gov/Archives/edgar/data/42/000000004225000002/q.htm": b"<p>q</p>",
}


def never():
    raise AssertionError("the source was asked")


@pytest.fixture
def stocked(spark, tmp_path):
    """A warehouse with one ingested company, and its filings folder."""
    store, base = company.Warehouse(spark, str(tmp_path / "wh"), buckets=4), tmp_path / "filings"
    return store, base, company.ingest_company(" exm ", store, lambda: http.SavedClient(SAVED), "2025-11-03", filings_dir=base)


def test_ingest_company(spark, stocked):
    store, base, r = stocked
    assert (r.ticker, r.cik, r.status, r.sec_checked) == ("EXM", "0000000042", "initialized", True)
    assert (r.normalized_fact_count, r.stored_fact_count, r.stored_filing_count, r.stored_metric_count, r.active_metric_count) == (6, 6, 2, 1, 1)
    assert r.warnings == tuple(f"Normalized facts include quality flag: {f}" for f in ("ambiguous_unit", "duplicate_fact", "unsupported_form"))
    assert [f.form_type for f in r.filings] == ["10-Q", "10-K"] and all(p and open(p, "rb").read() for p in r.local_paths)
    assert store.facts.read().count() == 5 and {x.created_at for x in store.facts.read().collect()} == {dt.datetime(2025, 11, 3)}
    c = store.companies.read().first()
    assert (c.name, c.latest_10k_filing_date, c.next_check_date_10k, c.next_check_date_10q, c.company_id) == ("Example Corp", dt.date(2025, 10, 31), dt.date(2026, 10, 30), dt.date(2026, 1, 30), 42)
    m = store.metrics.read().first()
    f = store.filings.read().filter(F.col("accession_number") == m.accession_number).first()
    assert m.filing_id == f.filing_id and m.company_id == 42 and f.is_active_window and f.local_path.endswith("q.htm")
    text = report.ingestion_report(store.facts.read(), store.metrics.read(), store.filings.read(), r)
    assert "Run status: initialized" in text and "- Normalized facts include quality flag: duplicate_fact" in text and str(base) in text
    assert company.route_indicators(store, "0000000042").filter("skip_reason is null").count() == 0 and store.indicators.read().count() == 8
    assert company.route_metrics(store, "0000000042").count() == 1 and company.route_analytics(store, "0000000042").first().direction == "single_period"
    assert {x.section for x in company.route_analyze(store, "0000000042").collect()} == {"metrics", "trends", "evidence"}
    chunks = retrieval.sentence_chunks(spark.createDataFrame([("a", "Revenue grew. Costs fell.")], "acc string, text string"), id_col="acc", text_col="text")
    asked = company.route_ask(store, chunks, spark.createDataFrame([(1, "revenue"), (2, "nothing")], "query_id int, text string"))
    assert {(x.query_id, x.id, x.is_weak) for x in asked.collect()} == {(1, "a", False), (2, None, True)}


def test_ingestion_leaves_no_staged_tables(spark, stocked):
    from factweave.plans import staging

    held = len(staging._MADE)
    company.ingest_company("exm", stocked[0], lambda: http.SavedClient(SAVED), "2027-01-04")
    assert len(staging._MADE) == held and stocked[0].metrics.read().count() == 1
    with staging.scratch(spark):
        path = staging.staged(spark.range(3), "probe").inputFiles()[0].removeprefix("file://")
        assert open_exists(path)
    assert not open_exists(path)


def test_a_company_that_is_not_due_is_told_from_what_is_stored(stocked):
    store, _, _ = stocked
    r = company.ingest_company("exm", store, never, "2026-01-29")
    assert (r.status, r.sec_checked, r.refresh_due_10k, r.refresh_due_10q, r.normalized_fact_count, r.stored_filing_count, r.stored_metric_count) == ("reused_local", False, False, False, 0, 2, 1)
    assert len(r.filings) == 2 and all(r.local_paths)


def test_a_refresh_that_fails_falls_back(stocked):
    store, _, _ = stocked
    bad = SAVED | {company.FACTS_URL.format(cik="0000000042"): b'{"cik": 42}'}
    for client in (lambda: http.SavedClient({}), lambda: http.Client(" "), lambda: http.SavedClient(bad)):
        r = company.ingest_company("42", store, client, "2026-11-01")
        assert r.status == "refresh_failed_using_local_data" and r.sec_checked and r.refresh_due_10k and r.refresh_due_10q
        assert len(r.warnings) == 1 and r.warnings[0].startswith("SEC refresh failed; using existing local data: ")
    for name, error in (("zzz", http.TickerNotFound), (" ", ValueError)):
        with pytest.raises(error):
            company.ingest_company(name, store, lambda: http.SavedClient(SAVED), "2026-11-01")


def test_a_due_refresh_without_news_moves_the_dates(stocked):
    store, base, _ = stocked
    saved = {k: v for k, v in SAVED.items() if "Archives" not in k}  # copies are used again
    r = company.ingest_company("EXM", store, lambda: http.SavedClient(saved), "2026-11-02", filings_dir=base)
    assert (r.status, r.refresh_due_10k, r.refresh_due_10q, r.normalized_fact_count) == ("checked_no_update", True, True, 6)
    c = store.companies.read().first()
    assert c.next_check_date_10k == c.next_check_date_10q == dt.date(2026, 11, 3) and c.created_at == dt.datetime(2025, 11, 3) and c.updated_at == dt.datetime(2026, 11, 2)


def test_filings_that_leave_the_window_lose_their_copies(stocked):
    store, base, r = stocked
    old = dict(zip((f.form_type for f in r.filings), r.local_paths))["10-Q"]
    later = json.loads(json.dumps(FACTS))
    for n in range(12):
        y, q = 2028 + n // 4, n % 4 + 1
        later["facts"]["us-gaap"]["Revenues"]["units"]["USD"].append(entry(5, y, f"Q{q}", "10-Q", f"n-{n}", f"{y}-01-01", f"{y}-03-31"))
    saved = SAVED | {company.FACTS_URL.format(cik="0000000042"): json.dumps(later).encode()}
    r = company.ingest_company("EXM", store, lambda: http.SavedClient(saved), "2031-01-02", filings_dir=base)
    assert r.warnings[-1].startswith("Active-window accessions missing from SEC recent filings: n-0, n-1, n-10, n-11, n-2 (+7 more)")
    left = {f.form_type: f.is_active_window for f in store.filings.read().collect()}
    assert left == {"10-K": True, "10-Q": False} and not open_exists(old) and r.status == "checked_no_update"


def open_exists(path):
    from pathlib import Path

    return Path(path).exists()


def test_delete_ingested_company(spark, stocked, tmp_path, monkeypatch):
    store, base, r = stocked
    other = spark.createDataFrame([("0000000007", "k")], "cik string, unique_key string")
    for c in spark.createDataFrame([], schema.FACTS).schema:
        if c.name not in other.columns:
            other = other.withColumn(c.name, F.lit(None).cast(c.dataType))
    store.facts.put(other, other)
    for name, text in (("tsla", "identifier 'TSLA'"), ("12345", "identifier '12345' (CIK 0000012345)")):
        gone = company.delete_ingested_company(name, store, filings_dir=base)
        assert not gone.company_found and gone.message == f"No ingested company found for {text}." and set(gone.deleted.values()) == {0} and gone.paths_deleted == ()
    gone = company.delete_ingested_company("exm", store, filings_dir=base)
    assert gone.message == "Deleted ingested company for identifier 'EXM' (CIK 0000000042)." and gone.cik == "0000000042" and gone.paths_skipped == ()
    assert gone.deleted == {"metrics": 1, "filings": 2, "facts": 5, "companies": 1} and not (base / "0000000042").exists()
    assert store.facts.read().count() == 1 and store.metrics.read().count() == store.filings.read().count() == store.companies.read().count() == 0
    assert not company.delete_ingested_company("exm", store).company_found
    with pytest.raises(ValueError):
        company.delete_ingested_company(" ", store)
    # a folder that can't be removed is told
    company.ingest_company("exm", store, lambda: http.SavedClient(SAVED), "2025-11-03", filings_dir=base)
    monkeypatch.setattr(files.shutil, "rmtree", lambda path: (_ for _ in ()).throw(PermissionError("locked")))
    gone = company.delete_ingested_company("42", store, filings_dir=base)
    assert gone.message == "Deleted ingested company for identifier '42' (CIK 0000000042), but some filing artifacts could not be removed."
    assert gone.paths_skipped == (str(base / "0000000042"),) and len(gone.paths_deleted) == 2


def test_export_tables(spark, stocked, tmp_path):
    store, _, _ = stocked
    of = store.of("0000000042")
    out = tmp_path / "csv"
    assert inventory.export_tables(of["companies"], of["filings"], of["facts"], of["metrics"], str(out)) == []
    assert [c.concept for c in spark.read.csv(str(out / "raw_xbrl_facts.csv"), header=True).collect()] == ["Assets", "Assets", "Revenues", "Revenues", "Revenues"]
    assert spark.read.csv(str(out / "metric_traceability_sample.csv"), header=True).first().document_url.endswith("q.htm")
    (tmp_path / "file").write_text("")
    warned = inventory.export_tables(of["companies"], of["filings"].limit(0), of["facts"], of["metrics"], str(tmp_path / "file"))
    assert len(warned) == 5 and all(w.startswith("CSV export skipped for ") for w in warned)


def test_command_line(spark, tmp_path, capsys):
    from factweave.__main__ import main

    asked = ["--env-file", str(tmp_path / "none"), "--warehouse", str(tmp_path / "wh"), "--filings-dir", str(tmp_path / "f"), "--as-of", "2025-11-03"]
    text = main(["exm", *asked, "--export", str(tmp_path / "csv")], spark=spark, client=lambda: http.SavedClient(SAVED))
    assert text.splitlines()[:3] == ["Ticker: EXM", "CIK: 0000000042", "Run status: initialized"] and capsys.readouterr().out.strip() == text
    assert (tmp_path / "csv" / "filings.csv").is_dir()
    assert "Run status: reused_local" in main(["42", *asked], spark=spark, client=never)
    assert main(["exm", *asked, "--delete"], spark=spark) == "Deleted ingested company for identifier 'EXM' (CIK 0000000042)."


def test_value_kinds(docs):
    bad = [entry(v, 2025, "FY", "10-K", "a", None, "2025-01-31") for v in (5, "5", 5.5, True, None)]
    got = normalize.normalize_companyfacts(docs({"cik": "1", "facts": {"us-gaap": {"X": {"units": {"USD": bad}}}}})).orderBy("pos").collect()
    assert [(r.value_kind, r.value_raw, r.value) for r in got] == [("number", "5", 5), ("string", "5", 5), ("number", "5.5", Decimal("5.5")), ("boolean", "true", None), (None, None, None)]


def test_deflated_answers():
    raw = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    for body in (zlib.compress(b"x"), raw.compress(b"x") + raw.flush()):
        assert http.decode(body, "deflate") == b"x"
    assert http.decode(b"x", None) == b"x"


# --- every query against its oracle ---------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "events", "documents", "pages", "embeddings", "benchmark", "conversations", "supplier"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
