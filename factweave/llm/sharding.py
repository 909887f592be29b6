"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one counts rows and bytes and so sets how many memory-sized buckets there
are; whole records are scattered into them uniformly by a seeded hash of the
record, so no source, id or group of copies can fill a bucket. Pass two gathers a
bucket's records, puts them in a fixed order and shuffles them with Spark's
seeded ``shuffle``, a Fisher-Yates over the array. Buckets follow one another; a
record's place in that sequence sets its shard (contiguous ranges whose counts
differ by one at most: law ``rows``) and its gapless slot. Where a bucket begins
is summed up in two steps, by runs of ``RUN`` buckets and within each run, so
bucket counts never reach the driver.

One partition holds one bucket or a few in bucket order, and the number of
partitions is fixed by the bucket count, so reruns and recomputed tasks agree.

Defined results: nulls are ordinary values and hash like any other; fewer rows
than shards leave shards empty; equal texts are records of their own; so are fully
equal rows, whose copies are numbered and scattered by number where they overfill a
bucket; an empty table gives no rows. Extra columns of any type but variants and
calendar intervals, which have no order, are carried along; one named ``shard`` or
``slot`` comes out as ``shard_in`` or ``slot_in``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import shared_dir, written

SHARDS = 8
SEED = 20_240_229
BUCKET_BYTES = 4 << 20
#: A bucket of over so many times ``bucket_bytes`` has its copies of one record scattered by copy.
HEAVY = 4
COPIES = 10_000
RUN = 4096
#: More buckets than a fourth of these share partitions.
PARTITIONS = 1 << 18


def _size(row: Column, schema: T.StructType) -> Column:
    """Bytes of a record: its strings and binaries, and 16 for each field."""
    out = F.lit(16 * len(schema))
    for f in schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(row[f.name]), F.lit(0))
    return out.cast("long")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_holds_map(f.dataType) for f in kind)


def _listed(c: Column, kind: T.DataType) -> Column:
    """Maps as arrays of their entries, which can be hashed and ordered."""
    if not _holds_map(kind):
        return c
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(c), lambda e: F.struct(_listed(e["key"], kind.keyType).alias("key"), _listed(e["value"], kind.valueType).alias("value")))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _listed(e, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*(_listed(c[f.name], f.dataType).alias(f.name) for f in kind)))


def _mapped(c: Column, kind: T.DataType) -> Column:
    """The inverse of :func:`_listed`."""
    if not _holds_map(kind):
        return c
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(c, lambda e: F.struct(_mapped(e["key"], kind.keyType).alias("key"), _mapped(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda e: _mapped(e, kind.elementType))
    return F.when(c.isNotNull(), F.struct(*(_mapped(c[f.name], f.dataType).alias(f.name) for f in kind)))


def _free_names(names: list[str]) -> list[str]:
    """The names, those of the operator's own columns changed."""
    taken, out = {n.lower() for n in names} | {"shard", "slot"}, []
    for n in names:
        if n.lower() in ("shard", "slot"):
            while n.lower() in taken:
                n += "_in"
            taken.add(n.lower())
        out.append(n)
    return out


def external_shuffle(df: DataFrame, *, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` in a seeded random order: every row once, with ``shard`` and ``slot``."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kinds = [f.dataType for f in df.schema]
    df = df.toDF(*_free_names(df.columns))
    names = df.columns
    packed = F.struct(*(_listed(F.col(f"`{n}`"), k).alias(n) for n, k in zip(names, kinds))).alias("row")
    records = df.select(packed)
    # pass one: how much there is, and the scatter
    size = _size(F.col("row"), records.schema["row"].dataType)
    rows, total = records.agg(F.count("*"), F.sum(size)).first()
    n_buckets = max(1, -(-(total or 0) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n_buckets)).cast("int")
    tagged = records.select(bucket.alias("bucket"), "row", size.alias("size"))
    counts = _counted(tagged)
    heavy = counts.filter((F.col("n") > 1) & (F.col("size") > HEAVY * bucket_bytes)).select("bucket")
    if not heavy.isEmpty():
        tagged = _scatter_copies(tagged, heavy, n_buckets, seed)
        counts = _counted(tagged)
    # pass two: one bucket at a time
    n_parts = min(4 * n_buckets, PARTITIONS)  # roomy, so that few buckets share a partition
    gathered = tagged.repartition(n_parts, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    gathered = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    out = gathered.join(_begins(counts), "bucket").select(F.posexplode("rows").alias("i", "row"), "first")
    place = F.col("first") + F.col("i")
    # ranges: the first (rows mod n) shards hold one row more than the others
    small, more = divmod(rows, n_shards)
    cut = more * (small + 1)
    late = F.lit(more) + F.floor((place - cut) / F.lit(max(small, 1)))
    shard = F.when(place < cut, F.floor(place / F.lit(small + 1))).otherwise(late).cast("int")
    out = out.select("row", place.alias("place"), shard.alias("shard"))
    base = F.col("shard") * F.lit(small).cast("long") + F.least(F.col("shard"), F.lit(more))
    unpacked = (_mapped(F.col("row")[n], k).alias(n) for n, k in zip(names, kinds))
    return out.select(*unpacked, "shard", (F.col("place") - base).alias("slot"))


def _counted(tagged: DataFrame) -> DataFrame:
    """(bucket, n, size), written."""
    return written(tagged.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "bucket-counts")


def _begins(counts: DataFrame) -> DataFrame:
    """(bucket, first): the place of each bucket's first record."""
    runs = counts.select("bucket", "n", F.floor(F.col("bucket") / RUN).alias("run"))
    # a row for each RUN buckets: some 1,500 at 100 TB
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    whole = runs.groupBy("run").agg(F.sum("n").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.select("bucket", "run", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("ahead"))
    return inside.join(whole, "run").select("bucket", (F.col("base") + F.col("ahead")).alias("first"))


def _scatter_copies(tagged: DataFrame, heavy: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """``tagged`` with the records of the heavy buckets, which only copies of a record can fill, scattered anew by copy.

    Copies are counted, combined on the map side, numbered in runs of ``COPIES`` that any task can write out, and
    hashed with their number. Equal records can stand for each other, so a recomputed task agrees.
    """
    equal = tagged.join(heavy, "bucket", "left_semi").groupBy("row", "size").agg(F.count("*").alias("n"))
    runs = equal.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    runs = runs.repartition(F.xxhash64("row", "at"))
    copies = runs.select("row", "size", F.explode(F.sequence("at", F.least(F.col("n"), F.col("at") + COPIES) - 1)).alias("i"))
    anew = F.pmod(F.xxhash64(F.lit(seed), "row", "i"), F.lit(n_buckets)).cast("int")
    return tagged.join(heavy, "bucket", "left_anti").unionByName(copies.select(anew.alias("bucket"), "row", "size"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write a folder for each shard, its records in slot order."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(like: DataFrame, path: str) -> DataFrame:
    """What :func:`write_shards` wrote of a frame like this one."""
    return like.sparkSession.read.schema(like.schema).parquet(path)


def digest(documents: DataFrame, **options) -> DataFrame:
    """The contract's columns, from the shards of whole documents that :func:`write_shards` wrote: law ``rows``."""
    shuffled = external_shuffle(documents, **options)
    at = f"{shared_dir(documents.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(shuffled, at)
    return read_shards(shuffled, at).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
