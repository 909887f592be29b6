"""Tables that are merged by key: versioned folders and a manifest.

A table is cut into buckets by a hash of one column. A change writes the buckets it
touches to a new folder and then a new manifest that names, for each bucket, the
folder that holds it; the manifest comes into being by one rename. Readers take the
newest manifest, so a change that stops anywhere leaves the table as it was before,
and what it left behind is removed by a later change. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge


class KeyedTable:
    """One table: its schema, the columns that name a row and the column whose hash deals rows to buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Iterable[str], *, deal_by: str, buckets: int = 1024, kept: int = 2):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.deal_by, self.buckets, self.kept = deal_by, buckets, kept

    # --- reading

    def read(self) -> DataFrame:
        return self._read(self._manifest()[1])

    def read_of(self, owner) -> DataFrame:
        """The rows of one ``deal_by`` value; only its bucket is read."""
        one = self.spark.range(1).select(F.lit(owner).alias(self.deal_by)).select(self._bucket()).first()[0]
        return self._read(self._manifest()[1], {str(one)}).filter(F.col(self.deal_by) == owner)

    def _read(self, held: dict[str, str], only: Iterable[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in held.items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- changes

    def merge(self, batch: DataFrame, *, order: str, keep_first: Iterable[str] = ()) -> None:
        """Rows of the batch replace those of their keys, the last by ``order`` wins."""
        touched = self._buckets_of(batch)
        at, held = self._manifest()
        rows = merge.upsert(self._read(held, touched), batch, self.keys, order=order, keep_first=keep_first)
        self._commit(at, held, rows, touched)

    def put(self, rows: DataFrame, owners: DataFrame) -> None:
        """``rows`` in place of all rows whose ``deal_by`` value is among the owners'."""
        touched = self._buckets_of(owners)
        at, held = self._manifest()
        others = merge.delete_by(self._read(held, touched), owners, [self.deal_by])
        self._commit(at, held, others.unionByName(rows.select(*others.columns)), touched)

    def delete(self, owners: DataFrame) -> int:
        """How many rows of the owners went."""
        touched = self._buckets_of(owners)
        at, held = self._manifest()
        before = self._read(held, touched)
        n = before.join(owners.select(self.deal_by).distinct(), self.deal_by, "left_semi").count()
        if n:
            self._commit(at, held, merge.delete_by(before, owners, [self.deal_by]), touched)
        return n

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.deal_by), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, rows: DataFrame) -> set[str]:
        return {str(r[0]) for r in rows.select(self._bucket()).distinct().collect()}  # at most ``buckets`` rows

    def _commit(self, at: int, held: dict[str, str], rows: DataFrame, touched: set[str]) -> None:
        folder = uuid.uuid4().hex
        rows = rows.select(*self.spark.createDataFrame([], self.schema).columns)
        # small buckets share tasks and large ones are split
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = {n.removeprefix("bucket=") for n in self._names(f"data/{folder}") if n.startswith("bucket=")}
        self._publish(at + 1, {b: f for b, f in held.items() if b not in touched} | dict.fromkeys(sorted(written), folder))
        self._clean(at + 1)

    # --- manifests

    def _hadoop(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._hadoop(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def _load(self, version: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0])

    def _manifest(self) -> tuple[int, dict[str, str]]:
        found = self._versions()
        return (found[-1], self._load(found[-1])) if found else (0, {})

    def _publish(self, version: int, held: dict[str, str]) -> None:
        fs, part = self._hadoop(f"manifests/{version:012d}.part")
        _, path = self._hadoop(f"manifests/{version:012d}.json")
        if fs.exists(path):
            raise RuntimeError(f"another writer changed {self.path}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if not fs.rename(part, path):
            raise OSError(f"could not publish version {version} of {self.path}")

    def _clean(self, version: int) -> None:
        """Remove manifests but the last ones, and folders that none of those names."""
        kept = [v for v in self._versions() if v > version - self.kept]
        needed = {f for v in kept for f in self._load(v).values()}
        stale = [f"data/{n}" for n in self._names("data") if n not in needed]
        stale += [f"manifests/{n}" for n in self._names("manifests") if n.endswith(".part") or int(n.removesuffix(".json")) not in kept]
        for name in stale:
            fs, path = self._hadoop(name)
            fs.delete(path, True)
