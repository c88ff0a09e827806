"""Shared first pass of the repeat operators: minimizer runs of every text, and removal of spans.

Neighbouring windows that share their least k-gram hash (minimizer) form a run; equal windows have equal minimizers, so
only runs whose key occurs again can hold a repeated window. Most of a corpus leaves the job here as one short row for
some dozens of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import byte_values, cover, slices, super_runs, word_hashes, words

#: Windows of a run from its first on are packed with it as at = STRIDE * a + n.
STRIDE = 1 << 16


def minimizer_runs(rows: DataFrame, ids: list[str], window: int, k: int, unit: str) -> DataFrame:
    """(ids..., key, ctx, at) of rows (ids..., text): a run has n windows from a on, at = STRIDE * a + n; unit: byte or word."""
    if not 0 < k <= window < STRIDE:
        raise ValueError(f"a window has at least as many units as its minimizer and fewer than {STRIDE}")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ids)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in slices(batch.column(len(ids))):
                if unit == "byte":
                    values, edge, plain = byte_values(data), bounds, data
                else:
                    start, end, edge = words(data, bounds)
                    values, plain = word_hashes(data, start, end), None
                text, a, n, key, ctx = super_runs(values, edge, window, k, plain)
                if len(text):
                    own = [batch.column(c).slice(i, j - i).take(pa.array(text)) for c in range(len(ids))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(key), pa.array(ctx), pa.array(a * STRIDE + n)], names=[*ids, "key", "ctx", "at"])

    return rows.select(*ids, "text").mapInArrow(runs, f"{kinds}, key bigint, ctx bigint, at bigint")


#: First window and number of windows of a run.
FIRST, COUNT = f"CAST(at DIV {STRIDE} AS INT) AS a", f"CAST(at % {STRIDE} AS INT) AS n"


def list_parts(column: pa.Array, *names: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and the fields of a column of lists of structs; a null is an empty list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64), {x: flat.field(x).to_numpy(zero_copy_only=False) for x in names}


def remove_spans(rows: DataFrame, spans: DataFrame, ids: list[str], window: int, unit: str) -> DataFrame:
    """Every row (ids..., doc_id, text) less what the windows (ids..., a, n) cover.

    doc_id, n_units, n_removed, n_spans (maximal removed runs), kept_text as bytes, and its sha256 in hex.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = spans.groupBy(*ids).agg(F.collect_list(F.struct("a", "n")).alias("s"))
    both = rows.join(lists, ids, "left").select("doc_id", "text", "s")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, span = list_parts(batch.column(2), "a", "n")
            for i, j, data, bounds in slices(batch.column(1)):
                raw = data.tobytes()
                start, end, edge = (None, None, bounds) if unit == "byte" else words(data, bounds)
                out = []
                for r in range(i, j):
                    lo, hi = int(edge[r - i]), int(edge[r - i + 1])
                    gone = np.zeros(hi - lo, bool)
                    if at[r + 1] > at[r]:
                        a, n = span["a"][at[r] : at[r + 1]].astype(np.int64), span["n"][at[r] : at[r + 1]].astype(np.int64)
                        gone = cover(a, n + window - 1, hi - lo)
                    if unit == "byte":
                        kept = raw[lo:hi] if not gone.any() else data[lo:hi][~gone].tobytes()
                    else:
                        left = np.flatnonzero(~gone) + lo
                        kept = b" ".join([raw[x:y] for x, y in zip(start[left].tolist(), end[left].tolist())])
                    out.append((hi - lo, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept, hashlib.sha256(kept).hexdigest()))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()), pa.array(columns[4])], names=["doc_id", "n_units", "n_removed", "n_spans", "kept_text", "kept_sha256"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_units bigint, n_removed bigint, n_spans bigint, kept_text binary, kept_sha256 string")
