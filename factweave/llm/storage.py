"""Intermediate tables in the folder that the whole cluster shares.

Multi-step operators cut lineage by writing a step to Parquet below
``spark.checkpoint.dir`` and reading it back, so a lost executor costs the step
that was running, never the ones before it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session without one gets a folder of its own (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="factweave-")
    return _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it back; its shuffle files go once the table stands."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what runs in here as soon as it is done."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], *, parts: int | None = None) -> DataFrame:
    """``df`` with the sums of all rows before each, in an order without ties, over any number of tasks.

    Rows are dealt to ranges and written with the number of their range; sums within a range follow from a window over
    it, those before a range from a row for each range.
    """
    ranges = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    dealt = written(ranges.withColumn("_part", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as shuffle partitions
    whole = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    whole = whole.select(F.col("_part").alias("_of"), *(F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    joined = inside.join(F.broadcast(whole), F.col("_part") == F.col("_of"))
    return joined.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def purge(spark: SparkSession, df: DataFrame) -> None:
    """Delete the tables behind ``df`` that :func:`written` made; call it after the last use."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = shared_dir(spark).removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if top in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
