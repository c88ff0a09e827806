"""Exact order statistics without sorting and without buffers that grow with the values.

A double's bits, with those of negative numbers turned over, order as the number does. Each pass counts every column's
values in the parts that hold a wanted rank, up to BUCKETS buckets a part, and keeps only the buckets that hold one; a
bucket whose least and greatest value agree, or that holds two values, is settled. A pass takes at least eleven bits off a
part's width, so six passes settle any column, and columns of few values or of one magnitude take two or three. Tasks
count in arrays, and what moves is one row for a bucket that is not empty.

Groups are selected from too (grouped_quantiles): rows are numbered in the order of group and value over all partitions, so
that a group's ranks are row numbers; a group of very many rows lies in many partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .rowid import with_row_id

BUCKETS = 1 << 11
TOP = np.int64(-(1 << 63))
#: Columns of one scan, and rows up to which groups keep their values in aggregation buffers.
CHUNK, SMALL = 60, 1 << 20


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; the two zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, ~bits, bits ^ TOP).view(np.uint64)


def from_bits(key: int) -> float:
    """The double of ordered bits."""
    bits = np.array([key], np.uint64).view(np.int64)
    return float(np.where(bits < 0, bits ^ TOP, ~bits).view(np.float64)[0])


class _Part:
    """A range of keys with ``before`` values below it; ranks are those wanted in it."""

    def __init__(self, column: int, low: int, high: int, before: int, ranks: list[int]):
        self.column, self.low, self.high, self.before, self.ranks = column, low, high, before, ranks
        self.shift = max(0, (high - low).bit_length() - BUCKETS.bit_length() + 1)


def _pass(rows: DataFrame, parts: list[_Part], every: bool) -> list:
    """(part, bucket, n, low, high) of the buckets of all parts that are not empty; every: one bucket over all keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(parts), BUCKETS + 1), np.int64)
        low, high = np.full(n.shape, np.iinfo(np.uint64).max, np.uint64), np.zeros(n.shape, np.uint64)
        for b in batches:
            seen: dict[int, np.ndarray] = {}
            for k, p in enumerate(parts):
                if p.column not in seen:
                    seen[p.column] = np.sort(ordered_bits(b.column(p.column).drop_null().to_numpy(zero_copy_only=False)))
                key = seen[p.column]
                if not every:
                    key = key[np.searchsorted(key, np.uint64(p.low)) : np.searchsorted(key, np.uint64(p.high), "right")]
                if not len(key):
                    continue
                bucket = np.zeros(len(key), np.int64) if every else ((key - np.uint64(p.low)) >> np.uint64(p.shift)).astype(np.int64)
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                stop = np.append(first[1:], len(key))
                at = bucket[first]
                n[k, at] += stop - first
                low[k, at], high[k, at] = np.minimum(low[k, at], key[first]), np.maximum(high[k, at], key[stop - 1])
        k, at = np.nonzero(n)
        cells = [k, at, n[k, at], (low[k, at] ^ np.uint64(1 << 63)).view(np.int64), (high[k, at] ^ np.uint64(1 << 63)).view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["part", "bucket", "n", "low", "high"])

    found = rows.mapInArrow(count, "part long, bucket long, n long, low long, high long").groupBy("part", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    if not every:  # only buckets that hold a wanted rank reach the driver, at most two for each quantile
        from pyspark.sql import Window

        wanted = rows.sparkSession.createDataFrame([(k, r - p.before) for k, p in enumerate(parts) for r in p.ranks], "part long, rank long")
        order = Window.partitionBy("part").orderBy("bucket")
        found = found.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(wanted), "part").where("rank < upto AND rank >= upto - n")
        found = found.groupBy("part", "bucket").agg(*[F.min(c).alias(c) for c in ("n", "low", "high", "upto")])
    return found.collect()


def _signed(x: int) -> int:
    """Ordered bits from the signed form in which tables carry them."""
    return x + (1 << 63)


def order_statistics(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float | None]]:
    """For each named number column its quantiles by linear interpolation between ranks; None for a column of nulls.

    A few numbers a column and share reach the driver.
    """
    out: dict[str, list[float | None]] = {}
    names = list(columns)
    for i in range(0, len(names), CHUNK):
        part = names[i : i + CHUNK]
        out |= _order_statistics(df.select(*[columns[n].cast("double").alias(f"c{k}") for k, n in enumerate(part)]), part, shares)
    return out


def _order_statistics(rows: DataFrame, names: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    first = [_Part(k, 0, 0, 0, []) for k in range(len(names))]
    size = {r["part"]: r for r in _pass(rows, first, True)}
    values: dict[tuple[int, int], float] = {}
    parts = []
    for k, r in size.items():
        spots = sorted({f(s * (r["n"] - 1)) for s in shares for f in (math.floor, math.ceil)})
        parts.append((k, _signed(r["low"]), _signed(r["high"]), 0, r["n"], spots))

    def settle(k: int, low: int, high: int, before: int, n: int, ranks: list[int]) -> _Part | None:
        """Values of ranks that are known; the part that is left to look into."""
        left = []
        for r in ranks:
            if low == high or r == before:
                values[k, r] = from_bits(low)
            elif r == before + n - 1:
                values[k, r] = from_bits(high)
            else:
                left.append(r)
        return _Part(k, low, high, before, left) if left else None

    todo = [p for x in parts if (p := settle(*x))]
    while todo:
        found, todo_next = _pass(rows, todo, False), []
        for r in found:
            p = todo[r["part"]]
            before = p.before + r["upto"] - r["n"]
            ranks = [x for x in p.ranks if before <= x < before + r["n"]]
            todo_next.append(settle(p.column, _signed(r["low"]), _signed(r["high"]), before, r["n"], ranks))
        todo = [p for p in todo_next if p]
    out: dict[str, list[float | None]] = {}
    for k, name in enumerate(names):
        if k not in size:
            out[name] = [None] * len(shares)
            continue
        out[name] = []
        for s in shares:
            at = s * (size[k]["n"] - 1)
            a, b = values[k, math.floor(at)], values[k, math.ceil(at)]
            # as Spark's percentile does it
            out[name].append(a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out


def quantile_table(df: DataFrame, columns: dict[str, Column], shares: list[float], name: str = "q") -> DataFrame:
    """(column, name): one row with the array of quantiles for each column."""
    found = order_statistics(df, columns, shares)
    return df.sparkSession.createDataFrame(list(found.items()), f"column string, {name} array<double>")


def grouped_quantiles(df: DataFrame, keys: list[str], columns: list[str], share: float = 0.5) -> DataFrame:
    """keys and, under its own name, the quantile of each number column in every group; null where a group has no value."""
    names = [f"_k{i}" for i in range(len(keys))]
    cells = df.select(*[col(k).alias(n) for k, n in zip(keys, names)], *[col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    if df.count() <= SMALL:
        return cells.groupBy(*names).agg(*[F.percentile(f"_v{i}", F.lit(share)).alias(f"_v{i}") for i in range(len(columns))]).select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *[F.col(f"_v{i}").alias(c) for i, c in enumerate(columns)])
    long = cells.unpivot(names, [f"_v{i}" for i in range(len(columns))], "_c", "_v").where("_v IS NOT NULL")
    numbered = with_row_id(long, ["_c", *names, "_v"], "_id")
    groups = numbered.groupBy("_c", *names).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    at = F.lit(share) * (F.col("_n") - 1)
    groups = groups.withColumns({"_at": at, "_a": F.col("_first") + F.floor(at), "_b": F.col("_first") + F.ceil(at)})
    value = numbered.select("_id", "_v")
    found = groups.join(value.select(F.col("_id").alias("_a"), F.col("_v").alias("_x")), "_a").join(value.select(F.col("_id").alias("_b"), F.col("_v").alias("_y")), "_b")
    mixed = F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise((F.ceil("_at") - F.col("_at")) * F.col("_x") + (F.col("_at") - F.floor("_at")) * F.col("_y"))
    wide = found.groupBy(*names).agg(*[F.max(F.when(F.col("_c") == f"_v{i}", mixed)).alias(f"_v{i}") for i in range(len(columns))])
    every = cells.select(*names).distinct()
    same = [every[n].eqNullSafe(wide[n]) for n in names]
    test = same[0]
    for s in same[1:]:
        test = test & s
    out = every.join(wide, test, "left")
    return out.select(*[every[n].alias(k) for k, n in zip(keys, names)], *[wide[f"_v{i}"].alias(c) for i, c in enumerate(columns)])
