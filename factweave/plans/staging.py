"""Steps of a plan as tables of the shared folder, so that later steps read them instead of working them out again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session without it gets a folder of its own, on a cluster it must be set."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="factweave-plan-")
    return _OWN[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there and a lost executor costs this step at most."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged in here are deleted at the end; what is made of them must be stored or collected by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(_MADE) > before:
            path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
            path.getFileSystem(conf).delete(path, True)
