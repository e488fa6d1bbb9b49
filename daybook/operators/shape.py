"""Small frame helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_or(key: Column, *row: str) -> Column:
    """``key``, or for a NULL key a value of the row's own that matches nothing.

    An outer join on a mostly-NULL key sends every NULL row to one task; this spreads them.
    """
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*row).cast("string")))


def look_up(df: DataFrame, table: DataFrame, key: str, *row: str) -> DataFrame:
    """Left join on ``key``, unique in ``table``, with the rows whose key is NULL spread by ``row``."""
    right = table.withColumnRenamed(key, "_key").withColumn("_key", F.col("_key").cast("string"))
    return (df.withColumn("_own", known_or(F.col(key).cast("string"), *row))
            .join(right, F.col("_own") == F.col("_key"), "left").drop("_own", "_key"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row, by union and MAX: no join of any kind."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
