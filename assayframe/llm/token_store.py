"""Token-id files: Parquet with list columns, dictionary and delta encoding, set row groups and page indexes.

``ids`` is dictionary-encoded (a vocabulary fits one dictionary page), ``doc_id``, ``shard`` and ``local_start`` are
delta-encoded; statistics in the page index let a reader fetch single documents, and the metadata columns are read
without touching ``ids``. Shards are ranges of (doc_id, text), so one number for each shard gives every global start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encode import text_encoder
from .spark_io import fresh_path, partitions


def write_tokens(docs: DataFrame, path: str | None = None, *, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", row_group_mb: int = 32, page_kb: int = 256, shards: int | None = None) -> str:
    """Encode each whole text, add end_id, and write the ids in ascending (doc_id, text) order; returns the path.

    A null or empty text is just the end id. A null doc_id comes first. Repeated rows are written as often as they
    come. Texts have any length. Other columns of docs are not written. An empty table gives files without rows. Files
    without a given path are in the shared folder and go when the driver's JVM ends.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shards or partitions(spark), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, done = text_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, ids, bounds in encoder.batches(batch.column(1)):
                if len(end):
                    ids = np.insert(ids, bounds[1:], end[0])
                    bounds = bounds + np.arange(len(bounds))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.full(j - i, shard, np.int32)), pa.array(done + bounds[:-1]), pa.array(np.diff(bounds)), lists], names=["doc_id", "shard", "local_start", "n_tokens", "ids"])
                done += len(ids)

    coded = rows.mapInArrow(encode, f"doc_id {kind}, shard int, local_start bigint, n_tokens bigint, ids array<int>")
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group_mb << 20), "parquet.page.size": str(page_kb << 10), "parquet.enable.dictionary": "true"}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "shard", "local_start", "n_tokens")}
    coded.write.options(**options).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if asked, ids of the rows that the condition on doc_id and n_tokens keeps.

    Conditions reach the Parquet scan, where row-group and page statistics skip what they rule out; without ids the
    token column is not read.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # one row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = files if where is None else files.where(where)
    out = rows.join(F.broadcast(offsets), "shard").withColumn("start", F.col("offset") + F.col("local_start"))
    return out.select("doc_id", "start", "n_tokens", *["ids"] * with_ids)


def crc_column(ids: pa.Array) -> np.ndarray:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    off, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
    raw = memoryview(flat).cast("B")
    return np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.int64)


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows of read_tokens."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc_column(b.column(3)))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
