"""Dense row numbers without a single-partition window."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_row_id(df: DataFrame, order_by: list[str] | None = None, name: str = "row_id") -> DataFrame:
    """df with dense 0-based numbers, in the order of the given columns or else of df's partitions.

    Partition and place in it are fixed in the checkpoint folder (a persisted copy where none is set), so every later
    use sees the same numbers. One count for each partition reaches the driver.
    """
    spark = df.sparkSession
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        placed = placed.checkpoint()
    else:
        placed = placed.persist(StorageLevel.DISK_ONLY_2)
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "_part int, _before long")
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    return out.select(*df.columns, name)
