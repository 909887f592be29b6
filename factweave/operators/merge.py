"""Keyed merges and deletes as functions of tables; :mod:`..sources.tables` stores what they give.

A merge is a union and one ranking by key; a key is compared with NULLs equal.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, batch: DataFrame, keys: Iterable[str], *, order: str, keep_first: Iterable[str] = ()) -> DataFrame:
    """Rows of both by key: the batch wins, within it the last by its column ``order``; ``keep_first`` columns stay as they were."""
    keys, keep = list(keys), list(keep_first)
    if order not in batch.columns:
        raise ValueError(f"the batch has no column {order} to tell its last rows by")
    tag = lambda df, n: df.withColumn("_batch", F.lit(n)).withColumn("_seq", F.col(order).cast("long") if n else F.lit(0).cast("long"))
    rows = tag(existing, 0).unionByName(tag(batch, 1), allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.col("_batch").desc(), F.col("_seq").desc_nulls_last())
    if keep:
        whole = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for c in keep:
            rows = rows.withColumn(f"_old_{c}", F.last(F.when(F.col("_batch") == 0, F.struct(c)), ignorenulls=True).over(whole))
    rows = rows.withColumn("_r", F.row_number().over(newest)).filter("_r = 1")
    for c in keep:
        rows = rows.withColumn(c, F.when(F.col(f"_old_{c}").isNotNull(), F.col(f"_old_{c}.{c}")).otherwise(F.col(c))).drop(f"_old_{c}")
    return rows.drop("_r", "_batch", "_seq")


def partial_update(existing: DataFrame, changes: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """``columns`` take the change where it isn't NULL; rows without a change stay."""
    keys, columns = list(keys), list(columns)
    new = changes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_n_{c}") for c in columns))
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    rows = existing.join(new, on, "left")
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(f"_n_{c}", c))
    return rows.select(*existing.columns)


def delete_by(table: DataFrame, gone: DataFrame, keys: Iterable[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascade_delete(tables: dict[str, DataFrame], ciks: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the given companies, and (table_name, n_deleted); an unknown company deletes nothing."""
    counts = None
    for name, df in tables.items():
        n = df.join(ciks.select("cik").distinct(), "cik", "left_semi").agg(F.lit(name).alias("table_name"), F.count("*").alias("n_deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return {name: delete_by(df, ciks, ["cik"]) for name, df in tables.items()}, counts
