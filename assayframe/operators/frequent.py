"""The commonest values of many columns by a mergeable sketch and an exact second count of its candidates.

Every task counts a column's values in COUNTERS counters. When there are too many, the count of the first that doesn't fit
is taken off all of them and what is left at zero goes; the counts taken off are the task's error. A value's true count is
at least its counter and at most the counter and the error, and the errors of all tasks together are at most the number of
rows / COUNTERS. So a value that no task has kept has at most that count: if the n-th of the counted candidates has more,
the n commonest are among them. Columns for which this doesn't hold, as keys, are counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, numeric_columns

#: Counters of a column in a task.
COUNTERS = 4096


class Counters:
    """Counts of values with an error: true counts are between a counter and the counter plus the error."""

    def __init__(self, size: int):
        self.size, self.error, self.counts = size, 0, {}

    def add(self, values: list, counts: list) -> None:
        held = self.counts
        for v, n in zip(values, counts):
            held[v] = held.get(v, 0) + n
        if len(held) > 2 * self.size:
            self.prune()

    def prune(self) -> None:
        """At most ``size`` counters are left."""
        if len(self.counts) > self.size:
            cut = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {v: n - cut for v, n in self.counts.items() if n > cut}
            self.error += cut


def sketched(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value as text, n, error): the counters of all tasks; a row without a value has a task's error."""
    size = COUNTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [Counters(size) for _ in columns]
        for b in batches:
            for k, s in enumerate(sketches):
                got = pc.value_counts(b.column(k).drop_null())
                s.add(got.field("values").to_pylist(), got.field("counts").to_pylist())
        for name, s in zip(columns, sketches):
            s.prune()
            cells = [[name] * (len(s.counts) + 1), [*s.counts, None], [*s.counts.values(), 0], [0] * len(s.counts) + [s.error]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["column", "value", "n", "error"])

    return df.select(*[col(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(count, "column string, value string, n long, error long")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("x")).select("x.*").where("value IS NOT NULL")


def _ranked(counts: DataFrame, numbers: list[str], n: int) -> DataFrame:
    """The n commonest of each column, ties by the value."""
    number = F.when(F.col("column").isin(numbers), F.col("value").try_cast("double")) if numbers else F.lit(None).cast("double")
    order: list[Column] = [F.desc("count"), F.asc_nulls_first(number), F.col("value")]
    return counts.withColumn("_k", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("_k") <= n)


def commonest(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """(column, value as text, count): the n commonest non-null values of each column, ties by value; exact."""
    numbers = [c for c in columns if c in set(numeric_columns(df))]
    merged = sketched(df, columns).groupBy("column", "value").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    best = Window.partitionBy("column").orderBy(F.desc("n"))
    found = merged.withColumn("_k", F.row_number().over(best)).where(F.col("value").isNull() | (F.col("_k") <= COUNTERS + 1))
    candidates, error = {}, {c: 0 for c in columns}
    for r in found.collect():  # COUNTERS values a column at most
        if r["value"] is None:
            error[r["column"]] = r["error"]
        else:
            candidates.setdefault(r["column"], []).append((r["n"], r["value"]))
    asked = []
    for c, values in candidates.items():
        values.sort(key=lambda x: -x[0])
        nth = values[min(n, len(values)) - 1][0]  # a lower bound of the n-th count
        asked += [(c, v) for k, v in values if k + error[c] >= nth]
    keys = F.broadcast(df.sparkSession.createDataFrame(asked, "column string, value string"))
    exact = _ranked(_long(df, columns).join(keys, ["column", "value"]).groupBy("column", "value").agg(F.count("*").alias("count")), numbers, n)
    rows = exact.collect()  # n values a column at most
    least = {c: min((r["count"] for r in rows if r["column"] == c), default=0) for c in columns}
    settled = [c for c in columns if not error[c] or (least[c] > error[c] and sum(r["column"] == c for r in rows) == n)]
    parts = [df.sparkSession.createDataFrame([(r["column"], r["value"], r["count"]) for r in rows if r["column"] in settled], "column string, value string, count long")]
    if rest := [c for c in columns if c not in settled]:
        full = _long(df, rest).groupBy("column", "value").agg(F.count("*").alias("count"))
        parts.append(_ranked(full, numbers, n).select("column", "value", "count"))
    return reduce(DataFrame.union, parts)
