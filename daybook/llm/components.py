"""Connected components of a link table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from daybook.session import durable


def _rows(*pairs: tuple[str, str | Column]) -> Column:
    """Generates a row ``(a, b)`` for each of the pairs."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("a"), (F.col(b) if isinstance(b, str) else b)
                                       .alias("b")) for a, b in pairs]))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours are linked to the least neighbour instead of to the node.

    The minimum and the join that follows share one shuffle of the neighbours; the join has one
    row per node on one side, so a node's neighbours stream through it and are never gathered.
    Rows may repeat.
    """
    around = links.select(_rows(("a", "b"), ("b", "a"))) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    around = around.repartition("a")
    least = around.groupBy("a").agg(F.min("b").alias("low")).select(
        "a", F.least("a", "low").alias("low"))
    moved = around.join(least, "a")
    out = moved.select(
        _rows(("b", F.when(F.col("b") > F.col("a"), F.col("low")).otherwise(F.col("b")))) if large
        else _rows(("b", "low"), ("a", "low")))
    return out.filter(F.col("a") != F.col("b"))


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` for every linked node; the least node names it.

    Alternates large-star and small-star steps until a round changes nothing, which takes about
    the logarithm of the longest path.  A round is three shuffles and a checkpoint in the shared
    folder, so that what the rounds leave on disk until Spark cleans up stays small; only a row
    count and a checksum, observed while it is written, reach the driver.
    """
    links, before = links.filter("a <> b"), None
    while True:
        seen = Observation()
        links = durable(_star(_star(links, large=True), large=False).distinct().observe(
            seen, F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")))
        now = seen.get
        if now == before or not now["n"]:
            return (links.select(_rows(("a", "b"), ("b", "b"))).groupBy(F.col("a").alias("node"))
                    .agg(F.min("b").alias("component")))
        before = now
