"""Scalar rules as Column functions; bad values become NULL, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCHIVE = "https://www.sec.gov/Archives/edgar/data"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def optional_text(x: Column | str) -> Column:
    """Trimmed, NULL if nothing is left."""
    return F.nullif(F.trim(_col(x)), F.lit(""))


def normalize_cik(x: Column | str) -> Column:
    """Ten digits, or NULL if it isn't a number of at most ten digits."""
    text = F.trim(_col(x).cast("string"))
    return F.when(text.rlike("^[0-9]{1,10}$"), F.lpad(text, 10, "0"))


def parse_date(x: Column | str) -> Column:
    """YYYY-MM-DD only (strict); anything else is NULL."""
    text = F.trim(_col(x))
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def parse_decimal(x: Column | str) -> Column:
    return F.trim(_col(x)).try_cast("decimal(38,10)")


def parse_int(x: Column | str) -> Column:
    text = F.trim(_col(x))
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def period_type(start: Column | str, end: Column | str) -> Column:
    return F.when(_col(end).isNull(), "unknown").when(_col(start).isNull(), "instant").otherwise("duration")


def period_rank(fp: Column | str) -> Column:
    """Q1 to Q4, then FY; anything else 0."""
    fp = F.upper(_col(fp))
    return F.when(fp.rlike("^Q[1-4]$"), F.substring(fp, 2, 1).cast("int")).when(fp == "FY", 5).otherwise(0)


def period_label(fy: Column | str, fp: Column | str, fallback: Column | None = None) -> Column:
    """FY2025, FY2026 Q2, the fallback, or 'unknown period'."""
    fy, fp = _col(fy), F.upper(_col(fp))
    year = F.concat(F.lit("FY"), fy.cast("string"))
    known = F.when(fy.isNotNull() & (fp.isNull() | (fp == "FY")), year).when(fy.isNotNull(), F.concat_ws(" ", year, fp)).when(fp.isNotNull(), fp)
    return F.coalesce(known, *([fallback.cast("string")] if fallback is not None else []), F.lit("unknown period"))


def document_url(cik: Column | str, accession: Column | str, document: Column | str) -> Column:
    return F.concat_ws("/", F.lit(ARCHIVE), _col(cik).cast("long").cast("string"), F.replace(_col(accession), F.lit("-"), F.lit("")), _col(document))


def safe_name(x: Column | str) -> Column:
    """Whether a name may become part of a path."""
    x = _col(x)
    return x.isNotNull() & (F.trim(x) != "") & ~x.rlike(r"[/\\]") & ~x.contains("..")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]+)$", 1)


def title(x: Column | str) -> Column:
    """operating_cash_flow as 'Operating Cash Flow'."""
    return F.initcap(F.replace(_col(x), F.lit("_"), F.lit(" ")))


def plural(word: str, n: Column | str) -> Column:
    """The word, with an s unless there is one."""
    return F.when(_col(n) == 1, F.lit(word)).otherwise(F.lit(f"{word}s"))


def deduped(items: Column) -> Column:
    """Each item once, where it came first."""
    return F.array_distinct(items)


def counted(n: Column | str, word: str) -> Column:
    """'1 concept', '2 concepts'."""
    return F.concat(_col(n).cast("string"), F.lit(" "), plural(word, n))


def yes_no(x: Column | str, unknown: str = "unknown") -> Column:
    return F.when(_col(x).isNull(), unknown).when(_col(x), "yes").otherwise("no")


def joined(items: Column, limit: int | None = None) -> Column:
    """All items joined, or the first ones and how many more there are; 'none' without any."""
    whole = F.when(F.size(items) == 0, "none").otherwise(F.array_join(items, ", "))
    if limit is None:
        return whole
    some = F.concat(F.array_join(F.slice(items, 1, limit), ", "), F.lit(" ... (+"), (F.size(items) - limit).cast("string"), F.lit(" more)"))
    return F.when(F.size(items) > limit, some).otherwise(whole)


def cell(x: Column | str) -> Column:
    """A Markdown cell: one line, no bars, at most 120 characters."""
    text = F.regexp_replace(F.coalesce(_col(x).cast("string"), F.lit("")), r"\r\n|\n|\r", " ")
    text = F.replace(text, F.lit("|"), F.lit("/"))
    return F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 117), F.lit("..."))).otherwise(text)


def shortened(items: Column, limit: int = 5) -> Column:
    """The first items joined, then how many more there are; 'none' without any."""
    more = F.size(items) - limit
    text = F.array_join(F.slice(items, 1, limit), ", ")
    return F.when(F.size(items) == 0, "none").when(more > 0, F.concat(text, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(text)
