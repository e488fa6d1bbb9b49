"""A total order over any number of rows without a window that spans them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.session import durable


def number_rows(df: DataFrame, keys: list[Column], out: str, partitions: int | None = None,
                ) -> DataFrame:
    """``df`` with ``out`` = 1, 2, 3 … in the order of ``keys`` (which must order totally).

    Range bounds come from a pass of their own, so ``df`` is checkpointed and made only once.
    Rows are range-partitioned on the keys, sorted and counted inside each partition, and each
    partition is shifted by the rows before it.  The sorted rows are checkpointed first, so
    range bounds and partition numbers cannot differ between the two passes, even when an
    executor is lost in between.  The shifts are one row per partition: a proven bound.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(durable(df).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                     .withColumn("_part", F.spark_partition_id())
                     .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(
                         F.lit((1 << 33) - 1))))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    return (placed.join(F.broadcast(shifts), "_part")
            .withColumn(out, F.col("_shift") + F.col("_at") + 1)
            .drop("_part", "_at", "_shift"))
