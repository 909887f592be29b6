"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed by source (map-side combined, so a hot source costs nothing),
targets follow from the weights, and each document is emitted floor(rate) times
plus once more where a seeded hash of its id falls below the rate's fraction.

Targets share ``share`` of all words by weight; a target stops at ``cap`` times
its source's size and the excess is shared again by weight until none is above.
That fixed point is ``min(cap * size, level * weight)`` for one level: with
sources in order of ``cap * size / weight`` those up to some place are capped,
and the level is what they leave over divided by the weights behind them.

Defined results: null text has size 0; a null source is a source of its own, the
last one; a source without words has rate 0; documents with equal ids and equal
text draw alike, with a null id by their text alone; an empty table gives no rows.
Extra columns are carried along; names starting with ``_fw_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import running_sums, written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 17
_WORD = r"[^ \t-\r]+"


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, text_hash: Column | None = None, seed: int = SEED) -> Column:
    """A number in [0, 1) that the seed and the document decide: the first 48 bits of an MD5."""
    told = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("-") if text_hash is None else text_hash))
    return F.conv(F.substring(F.md5(told), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, *, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size), a row for each source; any number of sources."""
    by_name = [F.col("source").asc_nulls_last()]
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    ranked = running_sums(sizes, by_name, {"_r": F.lit(1)})
    ranked = ranked.select("source", "source_size", F.element_at(cycle, (F.col("_r") % len(weights) + 1).cast("int")).cast("long").alias("_w"))
    # capped first: those with the least size for their weight
    by_need = [(F.col("source_size") / F.col("_w")).asc(), F.col("source").asc_nulls_last()]
    ranked = written(running_sums(ranked, by_need, {"_before": F.col("source_size"), "_w_before": F.col("_w")}), "mix-ranks")
    words, all_weights = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    # the level if all before this source are capped; the first source it doesn't cap has the true one
    left, behind = F.lit(words) - cap * F.col("_before"), F.lit(all_weights) - F.col("_w_before")
    level = left.cast("double") / behind.cast("double")
    fits = level * F.col("_w") <= (cap * F.col("source_size")).cast("double")
    found = ranked.filter(fits).agg(F.max_by(level, behind)).first()[0]
    goal = F.least((cap * F.col("source_size")).cast("double"), F.lit(0.0 if found is None else found) * F.col("_w"))
    return ranked.select("source", "source_size", goal.alias("target"), F.when(F.col("source_size") > 0, goal / F.col("source_size")).otherwise(0.0).alias("rate"))


def plan_copies(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """``documents`` with ``_fw_size``, ``_fw_total``, ``_fw_target`` and ``_fw_copies`` added."""
    sized = documents.withColumn("_fw_size", word_count(F.col(text_col)))
    totals = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("_fw_size").alias("source_size"))
    goals = written(targets(totals, weights=weights, cap=cap), "mix-targets").select(
        F.col("source").alias("_fw_source"), F.col("source_size").alias("_fw_total"), F.col("target").alias("_fw_target"), F.col("rate").alias("_fw_rate")
    )
    joined = sized.join(goals, F.col(source_col).eqNullSafe(F.col("_fw_source")), "left")
    chance = draw(F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))), seed)
    whole = F.floor("_fw_rate")
    copies = (whole + F.when(chance < F.col("_fw_rate") - whole, 1).otherwise(0)).cast("int")
    return joined.withColumn("_fw_copies", copies).drop("_fw_source", "_fw_rate")


def mix_sources(documents: DataFrame, **options) -> DataFrame:
    """The mix: every document as often as it is taken, all its columns kept."""
    planned = plan_copies(documents, **options).filter("_fw_copies > 0")
    names = [F.col(f"`{c}`") for c in documents.columns]
    return planned.select(*names, F.explode(F.sequence(F.lit(1), F.col("_fw_copies"))).alias("_fw_copy")).drop("_fw_copy")


def digest(planned: DataFrame) -> DataFrame:
    """The contract's columns, from :func:`plan_copies`."""
    return planned.select(
        "doc_id", F.col("_fw_size").alias("size"), F.col("_fw_total").alias("source_size"), F.col("_fw_target").alias("target"),
        (F.col("_fw_copies") * F.col("_fw_size")).cast("long").alias("taken"),
    )
