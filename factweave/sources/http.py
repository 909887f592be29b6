"""Fetch documents and land them for Spark.

Fetching stays on the driver: the source allows so many requests a second for a
client, which executors could not share.
"""

from __future__ import annotations

import gzip
import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RETRY_CODES = (429, 500, 502, 503, 504)


class SourceError(Exception):
    """The source gave no usable answer."""


class TickerNotFound(SourceError, LookupError):
    """The source knows no such ticker."""


def decode(body: bytes, encoding: str | None) -> bytes:
    kind = (encoding or "").lower()
    if kind == "gzip":
        return gzip.decompress(body)
    if kind == "deflate":
        try:
            return zlib.decompress(body)
        except zlib.error:
            return zlib.decompress(body, -zlib.MAX_WBITS)
    return body


class Client:
    """GET with a least interval between requests and linear backoff."""

    def __init__(
        self, user_agent: str, *, timeout: float = 30, retries: int = 2, backoff: float = 0.5, interval: float = 0.1,
        opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep, clock: Callable = time.monotonic,
    ):
        if not user_agent.strip():
            raise SourceError("a user agent is needed")
        self.agent, self.timeout, self.retries, self.backoff, self.interval = user_agent, timeout, retries, backoff, interval
        self.opener, self.sleep, self.clock = opener, sleep, clock
        self.last: float | None = None

    def get(self, url: str, accept: str = "*/*") -> bytes:
        request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept": accept, "Accept-Encoding": "gzip, deflate"})
        for attempt in range(self.retries + 1):
            wait = 0 if self.last is None else self.interval - (self.clock() - self.last)
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                with self.opener(request, timeout=self.timeout) as answer:
                    return decode(answer.read(), answer.headers.get("Content-Encoding"))
            except urllib.error.HTTPError as e:
                if e.code not in RETRY_CODES or attempt == self.retries:
                    raise SourceError(f"{url}: HTTP {e.code}") from e
            except urllib.error.URLError as e:
                if attempt == self.retries:
                    raise SourceError(f"{url}: {e.reason}") from e
            self.sleep(self.backoff * (attempt + 1))
        raise AssertionError("unreachable")

    def get_json(self, url: str) -> dict:
        try:
            found = json.loads(self.get(url, "application/json"))
        except ValueError as e:
            raise SourceError(f"{url}: not JSON") from e
        if not isinstance(found, dict):
            raise SourceError(f"{url}: not a JSON object")
        return found


def land(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Fetched documents as a (json) table."""
    return spark.createDataFrame([(json.dumps(d),) for d in documents], "json string")


class SavedClient(Client):
    """Answers from saved documents {address: bytes} in place of the network."""

    def __init__(self, saved: dict[str, bytes]):
        super().__init__("saved documents", interval=0)
        self.saved = saved

    def get(self, url: str, accept: str = "*/*") -> bytes:
        if url not in self.saved:
            raise SourceError(f"{url}: not saved")
        return self.saved[url]


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files (also compressed) as (json), one document each."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
