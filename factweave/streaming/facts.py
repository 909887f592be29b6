"""Facts that arrive as files, merged by key batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..sources.tables import KeyedTable


def fact_stream(spark: SparkSession, path: str, *, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.FACTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fact_table(spark: SparkSession, path: str, **options) -> KeyedTable:
    return KeyedTable(spark, path, schema.FACTS, ["unique_key"], deal_by="cik", **options)


def merge_stream(facts: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Restated facts replace those of their key, new ones are added; a repeated batch changes nothing.

    A batch rewrites the buckets of its companies only.
    """

    def merge_batch(batch: DataFrame, _: int) -> None:
        table.merge(batch, order="batch_pos")

    return facts.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
