"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is two joins against the least neighbour of each node, so a node
with very many links is an ordinary skewed join that adaptive execution splits;
nothing is gathered by node or on the driver. A round is written to the shared
folder, and two numbers tell whether it changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import purge, written


def _star(both: DataFrame, *, large: bool) -> DataFrame:
    """Hang neighbours (larger ones, or smaller ones and the node itself) on the least neighbour."""
    side = both if large else both.filter("b < a")
    least = side.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    hung = side.join(least, side.a == least.n)
    if large:
        out = hung.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = hung.select(F.col("b").alias("x"), F.col("m").alias("y")).filter("x <> y").unionByName(least.select(F.col("n").alias("x"), F.col("m").alias("y")))
    return out.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).filter("a <> b").distinct()


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("decimal(38,0)")).first())


def connected_components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the least node of its component.

    Defined results: self-links and nulls link nothing and name no node; repeated
    links count once; an empty table gives no rows.
    """
    links = links.select("a", "b").filter("a is not null and b is not null and a <> b")
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(links)
    for _ in range(rounds):
        if not mark[0]:
            break
        # small stars need only links from a node to smaller ones, which is how rounds are stored
        before, links = links, written(_star(_star(_both(links), large=True), large=False), "links")
        purge(links.sparkSession, before)
        if (now := _mark(links)) == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # settled: every node hangs on its root
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
