"""The projected table of interactions: person buckets sized to the data, replaced by version.

A manifest says which version of each bucket counts.  Its row is written last, so a run that is cut
off leaves the table as it was, and one done again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.session import durable
from daybook.sources.tables import exists, read_upto, write_batch

#: Interactions that a bucket holds on average when the table is laid out, and how many times as
#: many it may hold before the next run lays it out anew with more buckets.
BUCKET_ROWS, CROWDED = 1_000_000, 4

_MANIFEST = T.StructType([T.StructField("layout", T.LongType()),
                          T.StructField("buckets", T.LongType()),
                          T.StructField("bucket", T.LongType()),
                          T.StructField("rows", T.LongType())])
_LAST = (1 << 63) - 1


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("person_id"), buckets)


def current_buckets(spark: SparkSession, path: str, upto: int = _LAST) -> DataFrame:
    """``layout, buckets, bucket, version, rows`` of every bucket as the newest version has it."""
    rows = read_upto(spark, f"{path}/manifest", _MANIFEST, upto)
    newest = rows.groupBy("layout", "buckets", "bucket").agg(
        F.max(F.struct("batch", "rows")).alias("at"))
    last = rows.agg(F.max("layout").alias("layout"))
    return (newest.join(F.broadcast(last), "layout")              # one row
            .select("layout", "buckets", "bucket", F.col("at.batch").alias("version"),
                    F.col("at.rows").alias("rows")))


def _held(spark: SparkSession, path: str, schema: T.StructType, buckets: DataFrame) -> DataFrame:
    """The projected rows of these buckets; the join prunes the folders that are read."""
    if not exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("version", T.LongType()),
                         T.StructField("bucket", T.LongType())])
    wanted = buckets.filter("rows > 0").select("version", "bucket")
    return (spark.read.schema(full).parquet(f"{path}/data").join(wanted, ["version", "bucket"])
            .select(schema.names))


def read_projection(spark: SparkSession, path: str, schema: T.StructType,
                    persons: DataFrame | None = None, upto: int = _LAST) -> DataFrame:
    """The projected interactions; with ``persons`` only theirs, from their buckets alone."""
    buckets = current_buckets(spark, path, upto)
    if persons is None:
        return _held(spark, path, schema, buckets)
    asked = persons.select("person_id").distinct()
    count = buckets.agg(F.max("buckets")).scalar()
    mine = asked.select(_bucket(count).alias("bucket")).distinct()
    return (_held(spark, path, schema, buckets.join(mine, "bucket"))
            .join(asked, "person_id", "left_semi"))


def write_projection(interactions: DataFrame, touched: DataFrame, path: str, version: int,
                     bucket_rows: int = BUCKET_ROWS) -> None:
    """Project the interactions of the touched persons; ``version`` numbers the run, from 0.

    Only buckets of touched persons are read and written again: what they hold of others stays, the
    touched persons' rows are replaced by those in ``interactions``, and a bucket left without rows
    is recorded as empty.  Persons without an id are not projected.  The first run, and one that
    finds buckets ``CROWDED`` times too full, lays the whole table out for its size.
    """
    spark, schema = interactions.sparkSession, interactions.schema
    now = current_buckets(spark, path, version - 1).agg(
        F.max("layout").alias("layout"), F.max("buckets").alias("buckets"),
        F.sum("rows").alias("rows")).first()
    named = interactions.filter("person_id IS NOT NULL")
    fresh = now["layout"] is None or now["rows"] > CROWDED * bucket_rows * now["buckets"]
    if fresh:
        rows, layout = named, version
        buckets = max(1, -(-named.count() // bucket_rows))
        places = spark.range(buckets).select(F.col("id").alias("bucket"))
    else:
        layout, buckets = now["layout"], now["buckets"]
        persons = durable(touched.filter("person_id IS NOT NULL").select("person_id").distinct())
        places = persons.select(_bucket(F.lit(buckets)).alias("bucket")).distinct()
        before = current_buckets(spark, path, version - 1).join(places, "bucket")
        others = _held(spark, path, schema, before).join(persons, "person_id", "left_anti")
        rows = others.unionByName(named.join(persons, "person_id", "left_semi"))
    placed = rows.withColumn("bucket", _bucket(F.lit(buckets))).withColumn(
        "version", F.lit(version).cast("bigint"))
    # By bucket first: a bucket gets one file (more when it is large), not one from every task.
    (placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version", "bucket").parquet(f"{path}/data"))
    full = T.StructType([*schema.fields, T.StructField("version", T.LongType()),
                         T.StructField("bucket", T.LongType())])
    written = spark.read.schema(full).parquet(f"{path}/data") if exists(
        spark, f"{path}/data") else spark.createDataFrame([], full)
    counts = written.filter(F.col("version") == version).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"))
    write_batch(places.join(counts, "bucket", "left").select(
        F.lit(layout).cast("bigint").alias("layout"), F.lit(buckets).cast("bigint")
        .alias("buckets"), "bucket", F.coalesce("rows", F.lit(0)).alias("rows")),
        f"{path}/manifest", version)
