"""Parquet tables: given ones by name, and growing ones written batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df


_MERGED = T.StructType([T.StructField("upto", T.LongType())])


def read_upto(spark: SparkSession, path: str, schema: T.StructType, batch_id: int,
              since: int = 0) -> DataFrame:
    """Rows of a growing table that batches ``since`` .. ``batch_id`` wrote, ``batch`` included."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    merged = _newest_merge(spark, path)
    parts = [] if merged is None else [
        spark.read.schema(full).parquet(f"{path}.merged/data/generation={merged['batch']}")
        .filter(F.col("batch").between(since, batch_id))]
    if exists(spark, path):
        low = since if merged is None else max(since, merged["upto"] + 1)
        parts.append(spark.read.schema(full).parquet(path)
                     .filter(F.col("batch").between(low, batch_id)))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], full)


def _newest_merge(spark: SparkSession, path: str):
    """The generation of merged batches that counts and the last batch in it."""
    manifest = f"{path}.merged/manifest"
    if not exists(spark, manifest):
        return None
    full = T.StructType([*_MERGED.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(manifest).orderBy(F.desc("batch")).first()


def merge_batches(spark: SparkSession, path: str, schema: T.StructType, upto: int,
                  *by: str) -> None:
    """Put all batches up to ``upto``, none of which may run again, into one generation of files.

    The new generation is written beside the table, with its batch numbers as a column; then the
    manifest names it, which is what readers go by; only then do the batches' own folders and the
    generation before the last go.  Cut off at any point, the table reads the same, and the merge
    can be done again.  The last generation stays for readers that have just begun.
    """
    before = _newest_merge(spark, path)
    number = 0 if before is None else before["batch"] + 1
    rows = read_upto(spark, path, schema, upto)
    writer = (rows.repartition(*by) if by else rows.coalesce(1)).write.mode("overwrite").option(
        "partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).parquet(
        f"{path}.merged/data/generation={number}")
    write_batch(spark.createDataFrame([(upto,)], _MERGED).coalesce(1), f"{path}.merged/manifest",
                number)
    for folder, batch in batch_folders(spark, path, "batch"):
        if batch <= upto:
            _remove(spark, folder)
    for folder, generation in batch_folders(spark, f"{path}.merged/data", "generation"):
        if generation < number - 1:
            _remove(spark, folder)


def batch_folders(spark: SparkSession, path: str, name: str = "batch") -> list[tuple[str, int]]:
    """(folder, number) of every partition ``name=number`` right under ``path``."""
    if not exists(spark, path):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    named = [(f.getPath().toString(), f.getPath().getName()) for f in found]
    return sorted(((p, int(n.removeprefix(f"{name}="))) for p, n in named
                   if n.startswith(f"{name}=")), key=lambda x: x[1])


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def write_batch(df: DataFrame, path: str, batch_id: int, *by: str,
                watch: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write this batch's partition of a growing table; a second run replaces it.

    Rows go by ``by`` first, so a folder gets one file and not one from every task; the engine
    splits a folder that is too large for a task.  ``watch`` observes the rows after that shuffle:
    when a shuffle brings no rows, the engine drops what stands before it, observers too.
    """
    rows = df.hint("rebalance", *[F.col(c) for c in by]) if by else df
    rows = watch(rows) if watch else rows
    (rows.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path))
