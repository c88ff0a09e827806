"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the checkpoint folder, or persisted twice where none is set."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist(StorageLevel.DISK_ONLY_2)


def _ordered(links: DataFrame) -> DataFrame:
    """Links (u, v) with v < u, each once."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


#: Rows up to which a table of one least neighbour for each node is broadcast (two ids a row); above, joins shuffle.
BROADCAST_ROWS = 100_000


def _least(links: DataFrame, store: Callable[[DataFrame], DataFrame], *more) -> DataFrame:
    """(u, m) of each node of links (u, v): its least neighbour, stored, and broadcast where it is counted to be small."""
    low = store(links.groupBy("u").agg(F.min("v").alias("m"), *more))
    return F.broadcast(low) if low.count() <= BROADCAST_ROWS else low


def connected_components(links: DataFrame, store: Callable[[DataFrame], DataFrame] = keep) -> DataFrame:
    """(id, component) of every id in links (a, b), by alternating large and small stars.

    component is the least id in reach. Each round joins links with one minimum for each node, so a node with very many
    links is split by the skew join and never gathered, and ends when only stars are left: then every node has links
    down or up and one down at most, to its component.
    """
    e = store(_ordered(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    while True:
        both = e.union(e.select("v", "u"))
        low = _least(both, store, F.count_if(F.col("v") < F.col("u")).alias("down"), F.max(F.col("v") > F.col("u")).alias("up"))
        if low.where("down > 1 OR down = 1 AND up").isEmpty():
            break
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = _least(large, store)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = store(_ordered(small))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
