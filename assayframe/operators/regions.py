"""A metric partition for searches within a distance: pivots, regions around them, and halos across their borders.

A row lives in the region of its nearest pivot. It is also sent to every other region that can hold a row within eps of it.
Region j lies on its pivot's side of the hyperplane between pivots j and k, so a row whose distance from that hyperplane is
over eps for any k has no neighbour there; nor has one that is further from pivot j than the region's radius and eps.
Every row meets all its neighbours in its own region, so pairs are compared there and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that pivots are chosen from, rows a region should have, regions at most, and regions that a row may be sent to on
#: average; more regions are not worth their copies.
SAMPLE, REGION, MOST, COPIES = 4096, 256, 512, 6.0
#: Pivots of a row whose borders are looked at.
NEAREST = 4
#: Rows of a block, rows that a task holds before it sends its fullest region, and blocks on one key of the join.
BLOCK, HELD, SPREAD = 2048, 32_768, 64


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T), 0)


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Whether rows are no further from each other than eps; those that rounding could decide are computed again."""
    d, limit = squared(a, b), eps * eps
    out = d <= limit
    scale = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)
    i, j = np.nonzero(np.abs(d - limit) <= 1e-12 * (scale + limit))
    for at in range(0, len(i), 100_000):
        p, q = i[at : at + 100_000], j[at : at + 100_000]
        out[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1) <= limit
    return out


@dataclass
class Regions:
    """Pivots, the radius of each region, and how far a row looks."""

    pivots: np.ndarray
    eps: float
    radius: np.ndarray | None = None

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest pivot, squared distances from all pivots) of each row."""
        d = squared(x, self.pivots)
        return d.argmin(axis=1), d

    def members(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, whether each row is sent to each region, its home included)."""
        home, d = self.homes(x)
        apart = 2 * np.sqrt(squared(self.pivots, self.pivots))
        slack = 1e-9 * (1 + self.eps)
        sent = np.ones(d.shape, bool)
        # the borders of the nearest pivots' regions cut off most; those of all would cost the square of the pivots
        nearest = np.argpartition(d, min(NEAREST, d.shape[1]) - 1, axis=1)[:, :NEAREST]
        for k in nearest.T:
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = (d - d[np.arange(len(d)), k][:, None]) / apart[k]  # from the hyperplane between k and each pivot; on k's side positive
            sent &= ~(beyond > self.eps + slack)
        if self.radius is not None:
            sent &= np.sqrt(d) <= self.radius + self.eps + slack
        sent[np.arange(len(x)), home] = True
        return home, sent


def spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """k rows (fewer, if there are no more distinct ones), each the furthest from those before it among random ones."""
    some = x[np.random.default_rng(5).permutation(len(x))[: 8 * k]]
    chosen, far = [0], squared(some, some[:1])[:, 0]
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def choose(sample: np.ndarray, n: int, eps: float) -> Regions:
    """Regions for n rows: as many as REGION asks for, if the sample's rows go to no more than COPIES on average."""
    k = max(1, min(MOST, -(-n // REGION), len(sample)))
    while k > 1:
        found = Regions(spread_out(sample, k), eps)
        if found.members(sample)[1].sum() <= COPIES * len(sample):
            return found
        k //= 2
    return Regions(sample[:1], eps)


def sampled(points: DataFrame, v: str, order: Column) -> np.ndarray:
    """The vectors of SAMPLE rows at most, by the hash of a key."""
    rows = points.orderBy(F.xxhash64(order)).select(v).limit(SAMPLE).collect()
    return np.array([r[0] for r in rows], np.float64).reshape(len(rows), len(rows[0][0]) if rows else 0)


def fitted(points: DataFrame, eps: float, n: int, v: str = "z", key: str = "id") -> Regions | None:
    """Regions fitted on a sample, with the radius of each over all rows; one small row a region reaches the driver."""
    sample = sampled(points, v, F.col(key))
    if not len(sample):
        return None
    found = choose(sample, n, eps)

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(found.pivots), -1.0)
        for b in batches:
            if len(b):
                home, d = found.homes(matrix(b.column(0)))
                np.maximum.at(most, home, d[np.arange(len(home)), home])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most))), pa.array(most)], names=["region", "r2"])

    found.radius = np.full(len(found.pivots), -np.inf)
    for r in points.select(v).mapInArrow(radii, "region long, r2 double").groupBy("region").agg(F.max("r2").alias("r2")).collect():
        if r["r2"] >= 0:
            found.radius[r["region"]] = r["r2"] ** 0.5
    return found


def matrix(lists: pa.Array) -> np.ndarray:
    """A batch's vectors as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1 if len(lists) else 0)


BLOCKS = "region int, home boolean, block long, n long, ids binary, weights binary, marks binary, vectors binary"


def blocks(points: DataFrame, regions: Regions, halo: str = "true") -> DataFrame:
    """Blocks of one region's own rows or of its halo from points (id, weight, mark, z); halo: condition on halo rows.

    Tasks pack what they read, so no row is shuffled alone and a region of very many rows is many blocks.
    """

    def pack(region: int, home: bool, number: int, parts: list) -> pa.RecordBatch:
        ids, weights, marks, x = (np.concatenate(p) for p in zip(*parts))
        cells = [region, home, number, len(ids), *(a.tobytes() for a in (ids, weights, marks, x))]
        types = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names=[f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list] = {}
        count: dict[tuple[int, bool], int] = {}
        number = 0
        for b in batches:
            if not len(b):
                continue
            ids, weights, marks, may = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
            x = matrix(b.column(3))
            home, sent = regions.members(x)
            for r in np.flatnonzero(sent.any(axis=0)).tolist():
                own = home == r
                for is_home, these in ((True, np.flatnonzero(own)), (False, np.flatnonzero(sent[:, r] & ~own & may))):
                    for i in range(0, len(these), BLOCK):
                        part = these[i : i + BLOCK]
                        held.setdefault((r, is_home), []).append((ids[part], weights[part], marks[part], x[part]))
                        count[r, is_home] = count.get((r, is_home), 0) + len(part)
                        if count[r, is_home] >= BLOCK:
                            yield pack(r, is_home, number, held.pop((r, is_home)))
                            number, _ = number + 1, count.pop((r, is_home))
            while sum(count.values()) > HELD:
                key = max(count, key=count.get)
                yield pack(*key, number, held.pop(key))
                number, _ = number + 1, count.pop(key)
        for key, parts in held.items():
            yield pack(*key, number, parts)
            number += 1

    return points.select("id", "weight", "mark", "z", F.expr(halo).alias("_may")).mapInArrow(run, BLOCKS)


def ranked(stored: DataFrame) -> DataFrame:
    """Stored blocks with their rank among the blocks of their region, in the order of a hash, from 0 on."""
    key = F.xxhash64("ids", "region", "home")
    ranks = stored.select("region", key.alias("_key")).distinct()
    ranks = ranks.select("_key", (F.row_number().over(Window.partitionBy("region").orderBy("_key")) - 1).alias("rank"))
    return stored.withColumn("_key", key).join(F.broadcast(ranks), "_key").drop("_key")


def block_pairs(own: DataFrame, others: DataFrame) -> DataFrame:
    """Each block of a region's own rows in own (a_) with each block of its rows and halo in others (b_), from stored blocks.

    Keys are split by the number of blocks of a region on both sides, which one small row each tells the driver.
    """
    count = lambda df: {r["region"]: r["n"] for r in df.groupBy("region").agg(F.count("*").alias("n")).collect()}
    own = own.where("home")
    na, nb = count(own), count(others)
    wide = lambda n: max(SPREAD // 4, 4 * SPREAD // n, 1)  # blocks of own on one key
    keys = [(r, -(-n // wide(nb[r])), -(-nb[r] // SPREAD)) for r, n in na.items() if r in nb]
    keys = F.broadcast(own.sparkSession.createDataFrame(keys, "region int, a_salts int, b_salts int"))
    fields = ("ids", "weights", "marks", "vectors")
    salted = lambda n: F.pmod(F.xxhash64("ids"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = own.join(keys, "region").withColumn("i", salted("a_salts")).withColumn("j", every("b_salts"))
    b = others.join(keys, "region").withColumn("j", salted("b_salts")).withColumn("i", every("a_salts"))
    a = a.select("region", "i", "j", F.xxhash64("ids").alias("a_key"), *[F.col(c).alias(f"a_{c}") for c in fields])
    b = b.select("region", "i", "j", *[F.col(c).alias(f"b_{c}") for c in fields])
    return a.join(b, ["region", "i", "j"]).drop("region", "i", "j")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key of a, a's and b's ids, weights, marks and vectors) of each pair of blocks."""
    kinds = {"ids": np.int64, "weights": np.int64, "marks": np.bool_, "vectors": np.float64}
    for batch in batches:
        cells = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for at in range(len(batch)):
            get = lambda name: np.frombuffer(cells[name][at].as_py(), kinds[name[2:]])  # noqa: B023, E731
            sides = []
            for side in "ab":
                ids = get(f"{side}_ids")
                sides.append((ids, get(f"{side}_weights"), get(f"{side}_marks"), get(f"{side}_vectors").reshape(len(ids), -1)))
            yield cells["a_key"][at].as_py(), *sides
