"""The aggregates that plots draw."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high, n: equal-width bins over the non-null values, the last one closed; empty bins are listed."""
    require(df, [column])
    x = col(column).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    rows = df.where(x.isNotNull()).select(x.alias("x")).join(F.broadcast(span))
    at = F.when(F.col("w") == 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)))
    counts = rows.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = span.where("lo IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "w")
    out = grid.join(counts, "bin", "left")
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def density(df: DataFrame, column: str, points: int = 200, fine: int = 2000) -> DataFrame:
    """x, density: Gaussian kernel curve on ``points`` places, from counts in ``fine`` bins (both fixed numbers)."""
    x = col(column).cast("double")
    stats = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    counts = histogram(df, column, fine).where("n > 0").select(((F.col("low") + F.col("high")) / 2).alias("m"), F.col("n").alias("k"))
    grid = stats.where("n > 1 AND s > 0").select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "*").withColumn("h", F.col("s") * F.pow(F.col("n"), -0.2))
    grid = grid.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    pairs = counts.join(F.broadcast(grid))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("m")) / F.col("h"), 2)) * F.col("k")
    return pairs.groupBy("i", "x").agg((F.sum(kernel) / (F.max("n") * F.max("h") * math.sqrt(2 * math.pi))).alias("density")).select("x", "density")


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50, colour: str | None = None) -> DataFrame:
    """x_bin, y_bin, n and the mean colour of the points in each cell of a bins x bins grid."""
    require(df, [x, y, *([colour] if colour else [])])
    rows = df.where(col(x).isNotNull() & col(y).isNotNull())
    span = rows.agg(*[f(col(c).cast("double")).alias(n) for c, n, f in ((x, "x0", F.min), (x, "x1", F.max), (y, "y0", F.min), (y, "y1", F.max))])
    cell = lambda c, k: F.when(F.col(f"{k}1") == F.col(f"{k}0"), 0).otherwise(F.least(F.floor((col(c) - F.col(f"{k}0")) / (F.col(f"{k}1") - F.col(f"{k}0")) * bins), F.lit(bins - 1))).cast("int")
    out = rows.join(F.broadcast(span)).groupBy(cell(x, "x").alias("x_bin"), cell(y, "y").alias("y_bin"))
    return out.agg(F.count("*").alias("n"), *([F.avg(col(colour)).alias("colour")] if colour else []))


def map_bins(df: DataFrame, x: str, y: str, resolution: float, value: str | None = None) -> DataFrame:
    """x, y (multiples of the resolution), n and the mean value of the points in each map cell."""
    require(df, [x, y, *([value] if value else [])])
    cell = lambda c: F.rint(col(c).cast("double") / resolution) * resolution
    rows = df.where(col(x).isNotNull() & col(y).isNotNull())
    return rows.groupBy(cell(x).alias("x"), cell(y).alias("y")).agg(F.count("*").alias("n"), *([F.avg(col(value)).alias("value")] if value else []))


def raster_level(cells: DataFrame, factor: int) -> DataFrame:
    """A coarser level of a cell table: means of band 1 in factor x factor cells."""
    return cells.groupBy("raster_id", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("b1").alias("b1"))


def cluster_summary(df: DataFrame, x: str, y: str, label: str) -> DataFrame:
    """cluster, n, centroid and bounding box of each label."""
    require(df, [x, y, label])
    box = [f(col(c).cast("double")).alias(f"{n}_{k}") for c, k in ((x, "x"), (y, "y")) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(col(label).alias("cluster")).agg(F.count("*").alias("n"), *box)


def cluster_bins(df: DataFrame, x: str, y: str, label: str, bins: int = 50) -> DataFrame:
    """cluster, x_bin, y_bin, n: the points of each label in the cells of one bins x bins grid over all of them."""
    require(df, [x, y, label])
    rows = df.where(col(x).isNotNull() & col(y).isNotNull())
    span = rows.agg(*[f(col(c).cast("double")).alias(n) for c, n, f in ((x, "x0", F.min), (x, "x1", F.max), (y, "y0", F.min), (y, "y1", F.max))])
    place = lambda c, k: F.when(F.col(f"{k}1") == F.col(f"{k}0"), 0).otherwise(F.least(F.floor((col(c) - F.col(f"{k}0")) / (F.col(f"{k}1") - F.col(f"{k}0")) * bins), F.lit(bins - 1))).cast("int")
    return rows.join(F.broadcast(span)).groupBy(col(label).alias("cluster"), place(x, "x").alias("x_bin"), place(y, "y").alias("y_bin")).agg(F.count("*").alias("n"))
