"""Clustering and dimension reduction on standardized features, which are one vector column throughout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require
from . import gram, regions
from .graph import connected_components, keep
from .rowid import with_row_id


def features(df: DataFrame, columns: list[str] | str) -> Column:
    """The features as one array: named number columns, or a column that is an array of numbers."""
    if isinstance(columns, str):
        require(df, [columns])
        return col(columns).cast("array<double>")
    require(df, columns)
    return F.array(*[col(c).cast("double") for c in columns])


def complete(x: Column) -> Column:
    """Whether a row has all its features."""
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))


def standardized(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Rows with all features, plus _z: an array by mean and population deviation (0 divides by 1).

    Means and deviations come from one pass over the vectors and are a literal of the plan, two numbers a feature.
    """
    rows = df.withColumn("_x", features(df, columns)).where(complete(F.col("_x")))
    mean, dev = gram.moments(rows, "_x")
    scale = F.transform(F.arrays_zip(F.col("_x").alias("x"), F.lit(mean).alias("m"), F.lit([s or 1.0 for s in dev]).alias("s")), lambda e: (e["x"] - e["m"]) / e["s"])
    return rows.withColumn("_z", scale if mean else F.col("_x")).drop("_x")


def _rest(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Rows that lack a feature."""
    return df.where(~complete(features(df, columns)))


#: Spark's largest number of steps, for k-means without a limit.
UNTIL_STILL = 2**31 - 1


def kmeans(df: DataFrame, columns: list[str] | str, k: int = 3, seed: int = 42, max_iter: int | None = None) -> DataFrame:
    """df with cluster_kmeans; null for rows with a null feature.

    Spark's parallel k-means from scalable seeds, iterated until no centre moves: every row then has the label of its
    nearest centre, and every centre is the mean of its rows. Each step brings rows nearer to their centres, so there is
    an end; it takes the more steps the more rows there are. A max_iter stops before it, short of a fixed point.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = keep(df)
    rows = standardized(df, columns).withColumn("_v", array_to_vector("_z"))
    model = KMeans(k=k, seed=seed, maxIter=UNTIL_STILL if max_iter is None else max_iter, tol=1e-12, featuresCol="_v", predictionCol="cluster_kmeans").fit(rows.select("_v"))
    done = model.transform(rows).select(*df.columns, "cluster_kmeans")
    return done.unionByName(_rest(df, columns).withColumn("cluster_kmeans", F.lit(None).cast("int")))


def pca(df: DataFrame, columns: list[str] | str, n: int = 2) -> tuple[DataFrame, list[float]]:
    """df with PCA1..PCAn (null for rows with a null feature), and the share of variance of each component.

    The components are eigenvectors of the features' Gram matrix, which one pass adds up by blocks; it has the square of
    the number of features and is decomposed on the driver. The largest loading of a component is positive.
    """
    df = keep(df)
    rows = standardized(df, columns)
    count, products = gram.gram(rows, "_z")
    width = len(products)
    names = [f"PCA{i + 1}" for i in range(n)]
    if not width:
        return df.withColumns({c: F.lit(None).cast("double") for c in names}), []
    if not 1 <= n <= width:
        raise ValueError(f"{n} components of {width} features")
    values, vectors = np.linalg.eigh(products / max(count - 1, 1))
    values, vectors = values[::-1], vectors[:, ::-1][:, :n]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(n)])
    share = np.maximum(values, 0) / max(np.maximum(values, 0).sum(), 1e-300)

    def score(i: int) -> Column:
        products = F.zip_with("_z", F.lit([float(x) for x in vectors[:, i]]), lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)

    done = rows.select(*df.columns, *[score(i).alias(c) for i, c in enumerate(names)])
    out = done.unionByName(_rest(df, columns).withColumns({c: F.lit(None).cast("double") for c in names}))
    return out, [float(x) for x in share[:n]]


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.where(col(label).isNotNull()).groupBy(col(label).alias("cluster")).agg(F.count("*").alias("size"))


def _counts(eps: float):
    """(id, n): weight of the rows within eps of each row of a block, by the blocks that come with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ids = total = None
        for now, a, b in regions.unpacked(batches):
            if now != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])
                key, ids, total = now, a[0], np.zeros(len(a[0]), np.int64)
            total = total + regions.within(a[3], b[3], eps) @ b[1]
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

    return run


def _links(eps: float):
    """(a, b): links that join what is connected between two blocks, a core always second. A core has one link at most, to
    the least core of its part; another row has one for each part in reach, marked by kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, a, b in regions.unpacked(batches):
            core = b[2]
            near = regions.within(a[3], b[3][core], eps)
            mine, other, own = a[0], b[0][core], a[2]
            none = np.iinfo(np.int64).max
            left, right = np.where(own, mine, none), other.copy()
            among = near[own]
            while True:  # least ids spread over the links between the two sides
                reach = np.where(among, right, none).min(axis=1, initial=none)
                new_left = np.minimum(left[own], reach)
                new_right = np.minimum(right, np.where(among, new_left[:, None], none).min(axis=0, initial=none))
                if (new_left == left[own]).all() and (new_right == right).all():
                    break
                left[own], right = new_left, new_right
            first, second = [mine[own], other], [left[own], right]
            i, j = np.nonzero(near[~own])
            edge = np.unique(np.stack([mine[~own][i], right[j]], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            x, y = np.concatenate(first), np.concatenate(second)
            some = x != y
            x, y = np.concatenate([x[some], edge[:, 0]]), np.concatenate([y[some], edge[:, 1]])
            kind = np.concatenate([np.zeros(int(some.sum()), np.int32), np.ones(len(edge), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(kind)], names=["a", "b", "kind"])

    return run


#: Blocks of a region that the first round compares points with; each further round of counts has GROWTH times as many.
FIRST, GROWTH = 4, 4


def _marked(points: DataFrame, found: regions.Regions, eps: float, least: int) -> DataFrame:
    """Points with mark: whether rows of a weight of least lie within eps. Those that are not yet known to be cores meet
    more blocks, round by round, in the end all of their region."""
    points = keep(points.withColumn("mark", F.lit(False)))
    blocks = keep(regions.ranked(regions.blocks(points, found)))
    last = blocks.agg(F.max("rank")).first()[0]
    open_, known, low, high = points.withColumn("n", F.lit(0).cast("long")), None, 0, FIRST
    while True:
        own = keep(regions.blocks(open_, found, "false"))
        pairs = regions.block_pairs(own, blocks.where((F.col("rank") >= low) & (F.col("rank") < high)))
        more = pairs.mapInArrow(_counts(eps), "id long, n long").groupBy("id").agg(F.sum("n").alias("more"))
        counted = keep(open_.join(more, "id", "left").select("id", "weight", "mark", "z", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        low, high = high, high * GROWTH
        open_ = counted.where(F.col("n") < least)
        done = low > last or open_.isEmpty()
        mark = (F.col("n") >= least).alias("mark")
        now = (counted if done else counted.where(F.col("n") >= least)).select("id", "weight", mark, "z")
        known = now if known is None else known.union(now)
        if done:
            return keep(known)


def _linked(points: DataFrame, found: regions.Regions, eps: float) -> DataFrame:
    """(a, b, kind) of _links for all cores and the other points in their reach, from marked points."""
    spanning = lambda own, blocks: keep(regions.block_pairs(own, blocks).mapInArrow(_links(eps), "a long, b long, kind int").distinct())
    blocks = keep(regions.ranked(regions.blocks(points, found, "mark")))
    if blocks.agg(F.max("rank")).first()[0] < FIRST:
        return spanning(blocks, blocks)
    links = spanning(keep(regions.blocks(points.where("mark"), found, "false")), blocks.where(F.col("rank") < FIRST))
    parts = keep(connected_components(links.select("a", "b")))
    largest = parts.groupBy("component").count().orderBy(F.desc("count"), "component").select("component").limit(1)
    inside = parts.join(F.broadcast(largest), "component", "left_semi")
    rest = points.join(inside, "id", "left_anti").select("id", "weight", "mark", "z")
    return links.union(spanning(keep(regions.blocks(rest, found, "false")), blocks))


def dbscan(df: DataFrame, columns: list[str] | str, row_id: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(row_id, cluster_dbscan) for every row: -1 is noise, null stands for rows with a null feature.

    A core has min_samples rows (itself included) within eps of the standardized features; clusters are connected cores,
    numbered by their least core row; a border row joins the lowest-numbered cluster in reach.

    Rows of equal features are one point with a weight. A metric partition (see regions) brings each point together with all
    its neighbours; two blocks give counts, and then no more links than they have rows, as each core is linked to the least
    core it is connected with there. Parts of different blocks meet in the rows they share. Where features lie so far
    apart that eps reaches across most borders, as in many dimensions without clusters, fewer regions are made, and large
    regions are compared in rounds: a point leaves as soon as it is known to be a core, and links are looked for only from
    the points outside the largest cluster of the first round, as no link within it is wanted. Only noise and small
    clusters are compared with all points of their region.
    """
    every = df.select(col(row_id).alias("_id"), features(df, columns).alias("_f"))
    numbered = dict(every.dtypes)["_id"] in ("tinyint", "smallint", "int", "bigint")
    every = keep(every.withColumn("id", F.col("_id").cast("long")) if numbered else with_row_id(every.where("_id IS NOT NULL"), ["_id"], "id"))
    rows = keep(standardized(every.where("id IS NOT NULL"), "_f").select("id", F.col("_z").alias("z")))
    points = keep(rows.groupBy("z").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    found = regions.fitted(points, eps, points.count())
    if found is None:
        return every.select(F.col("_id").alias(row_id), F.lit(None).cast("int").alias("cluster_dbscan"))
    points = _marked(points, found, eps, min_samples)
    links = _linked(points, found, eps)
    parts = connected_components(links.where("kind = 0").select("a", "b"))
    core = points.where("mark").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    numbers = with_row_id(core.select("component").distinct(), ["component"], "number")
    core = keep(core.join(numbers, "component").select("id", "number"))
    border = links.where("kind = 1").join(core.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("number").alias("reach"))
    labels = points.select("id", "z").join(core, "id", "left").join(border, "id", "left")
    labels = labels.select("z", F.coalesce("number", "reach", F.lit(-1)).cast("int").alias("cluster_dbscan"))
    labels = rows.join(labels, "z").select("id", "cluster_dbscan")
    return every.join(labels, "id", "left").select(F.col("_id").alias(row_id), "cluster_dbscan")
