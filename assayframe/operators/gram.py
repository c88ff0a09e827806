"""Sums and products of many columns in one pass, by matrix products over the batches of a task.

A task adds its batches up to a few matrices of columns x columns, and these are added in the shuffle: the cost of a pass
follows the rows, what moves follows the square of the columns. Values are taken less early ones of their column, so that sums
of squares keep their digits where a column lies far from zero; a constant column gives exact zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import matrix

#: Share of the squares below which what is left of them after the mean is rounding.
ROUNDING = 1e-13
#: Rows in which values to subtract are looked for first.
EARLY = 100


def early_values(rows: DataFrame, v: str) -> np.ndarray:
    """A value of each feature that a scan meets early; zero where all are null. The whole table is only read for features
    that the first EARLY rows don't have."""
    some = rows.select(v).where(F.size(v) > 0)
    first = some.first()
    out: dict[int, float] = {}
    for part in (some.limit(EARLY), some):
        if first and len(out) < len(first[0]):
            found = part.select(F.posexplode(v).alias("i", "x")).where("x IS NOT NULL").groupBy("i").agg(F.first("x").alias("x"))
            out |= {r["i"]: r["x"] for r in found.collect() if r["i"] not in out}
    return np.array([out.get(i, 0.0) for i in range(len(first[0]))] if first else [], np.float64)


def moments(rows: DataFrame, v: str) -> tuple[list[float], list[float]]:
    """Means and population deviations of a vector column without nulls; empty lists for no rows."""
    shift = early_values(rows, v)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(len(shift)), np.zeros(len(shift))
        for b in batches:
            if len(b):
                x = matrix(b.column(0)) - shift
                n, one, two = n + len(x), one + x.sum(axis=0), two + (x * x).sum(axis=0)
        if n:
            at = np.arange(len(shift))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), n)), pa.array(one), pa.array(two)], names=["i", "n", "one", "two"])

    parts = rows.select(v).mapInArrow(add, "i long, n long, one double, two double")
    out = sorted(parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "one", "two")]).collect())
    left = [max(r["two"] - r["one"] ** 2 / r["n"], 0.0) for r in out]
    return [float(shift[r["i"]]) + r["one"] / r["n"] for r in out], [(x / r["n"]) ** 0.5 if x > ROUNDING * r["two"] else 0.0 for x, r in zip(left, out)]


def gram(rows: DataFrame, v: str) -> tuple[int, np.ndarray]:
    """(rows, sums of the products of every two features) of a vector column without nulls; one number a pair is collected."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, products = 0, np.zeros((0, 0))
        for b in batches:
            if len(b):
                x = matrix(b.column(0))
                n, products = n + len(x), x.T @ x + (products if n else 0)
        if n:
            i, j = np.indices(products.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.full(len(i), n)), pa.array(products.ravel())], names=["i", "j", "n", "p"])

    parts = rows.select(v).mapInArrow(add, "i long, j long, n long, p double")
    summed = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()
    size = 1 + max((r["i"] for r in summed), default=-1)
    products = np.zeros((size, size))
    for r in summed:
        products[r["i"], r["j"]] = r["p"]
    return (summed[0]["n"] if summed else 0), products


def correlation_pairs(rows: DataFrame, v: str) -> DataFrame:
    """(i, j, r) of every two features i < j of a vector column: the correlation over the rows that have both; null where
    a side is constant there, or in no row."""
    shift = early_values(rows, v)
    width = len(shift)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for b in batches:
            if not len(b):
                continue
            flat = b.column(0).flatten()
            there = np.asarray(flat.is_valid()).reshape(-1, width).astype(np.float64)
            x = np.where(there > 0, flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width) - shift, 0.0)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        i, j = np.triu_indices(width, 1)
        cells = [i, j, total[0, i, j], total[1, i, j], total[1, j, i], total[2, i, j], total[2, j, i], total[3, i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["i", "j", *SUMS])

    parts = rows.select(v).where(F.size(v) > 0).mapInArrow(add, f"i long, j long, {', '.join(f'{c} double' for c in SUMS)}")
    out = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])
    own = lambda one, two: F.expr(f"CASE WHEN n * {two} - {one} * {one} > {ROUNDING} * n * {two} THEN n * {two} - {one} * {one} END")
    return out.select("i", "j", ((F.expr("n * xy - x * y")) / F.sqrt(own("x", "xx") * own("y", "yy"))).alias("r"))


#: Sums of a pair over the rows that have both: rows, values, squares, products.
SUMS = ["n", "x", "y", "xx", "yy", "xy"]
