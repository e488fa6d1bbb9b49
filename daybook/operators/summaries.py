"""Handing days to a summary writer and taking the answers back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.operators.landing import summary_problem
from daybook.operators.ranking import number_rows

# --- fixed values: the claim document ----------------------------------------------------------
CLAIM_FORMAT = 1
CLAIM_KIND = "summary-claim"
UNIT_ID = r"^u\d{2,}$"
# --- end of fixed values -------------------------------------------------------------------------


def link_presence(links: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Per unit: linked transcripts that exist and that are missing."""
    have = transcripts.select("link").distinct().withColumn("_t", F.lit(True))
    return links.join(have, "link", "left").groupBy("key").agg(
        F.count_if("_t").alias("found"), F.count_if(F.col("_t").isNull()).alias("missing"))


def claimable(queue: DataFrame, stamped: DataFrame, live: DataFrame,
              presence: DataFrame) -> DataFrame:
    """The queue with what decides a claim: held by another claim, transcript present."""
    return (queue.join(stamped.select("key"), "key", "left_anti")
            .join(live.select("key", F.lit(True).alias("is_held")), "key", "left")
            .join(presence.select("key", "found"), "key", "left")
            .withColumn("is_held", F.coalesce("is_held", F.lit(False)))
            .withColumn("has_transcript", F.coalesce(F.col("found") > 0, F.lit(False))))


def claim_pick(ready: DataFrame, limit: int) -> DataFrame:
    """The first unclaimed days by (day, key) that have a transcript: a distributed top-k."""
    return ready.filter("NOT is_held AND has_transcript").orderBy("day", "key").limit(limit)


def claim_counts(ready: DataFrame, limit: int) -> DataFrame:
    """Waiting, held by others, left waiting — and days with no transcript met on the way.

    A day without a transcript counts only until the pick is full, as the walk is by (day, key).
    """
    order = F.struct("day", "key")
    cut = claim_pick(ready, limit).agg(
        F.struct(F.max(order).alias("at"), F.count(F.lit(1)).alias("n"))).scalar()
    free = ~F.col("is_held")
    walked = (F.col("cut.n") < limit) | (order <= F.col("cut.at"))
    return (ready.withColumn("cut", cut)
            .agg(F.count_if(free).alias("waiting"), F.count_if("is_held").alias("held_by_others"),
                 F.count_if(free & ~F.col("has_transcript") & walked).alias("no_transcript"),
                 F.coalesce(F.max("cut.n"), F.lit(0)).alias("claimed"))
            .withColumn("left_waiting", F.greatest(
                F.col("waiting") - F.col("claimed") - F.col("no_transcript"), F.lit(0))))


def claim_batches(queue: DataFrame, limit: int) -> DataFrame:
    """All claimable days, oldest first, cut into documents of ``limit`` units.

    The total order comes from range partitions, so it is the same on any cluster, only the
    last document can be short, and no task sees more than its range.
    """
    return (number_rows(queue, [F.col("day"), F.col("key")], "no")
            .withColumn("batch", F.floor((F.col("no") - 1) / limit).cast("bigint"))
            .withColumn("unit_id", unit_id((F.col("no") - 1) % limit)))


def unit_id(index: Column) -> Column:
    """``u01``, ``u02`` … for a position counted from nought."""
    return F.format_string("u%02d", index + 1)


def claim_documents(units: DataFrame) -> DataFrame:
    """One JSON document per claim (at most ``claim_limit`` units, so the list is bounded)."""
    unit = F.struct(F.col("unit_id").alias("id"), "key", "name", "day", "direction", "link",
                    F.col("topic").alias("mechanical_topic"))
    return units.groupBy("claim_id").agg(F.sort_array(F.collect_list(unit)).alias("units")).select(
        "claim_id", F.to_json(F.struct(
            F.lit(CLAIM_FORMAT).alias("format"), F.lit(CLAIM_KIND).alias("kind"), "claim_id",
            "units", F.create_map().cast("map<string,string>").alias("summaries")))
        .alias("document"))


def write_claim_documents(documents: DataFrame, path: str) -> None:
    """The claims of a run as one table; writing the same claims again changes nothing."""
    documents.write.mode("overwrite").parquet(path)


DOCUMENT = ("format INT, kind STRING, claim_id STRING, units ARRAY<STRUCT<id: STRING, key: STRING,"
            "day: STRING, links: ARRAY<STRING>>>, summaries MAP<STRING, STRING>")


def parse_summary_docs(documents: DataFrame) -> DataFrame:
    """Documents with their parts, and why a malformed one is put aside (NULL when it is fine)."""
    d = F.from_json("document", DOCUMENT, {"mode": "PERMISSIVE"})
    ids = F.transform("d.units", lambda u: u["id"])
    problem = (F.when(F.col("d").isNull() | F.col("d.format").isNull(), "not a claim document")
               .when((F.col("d.format") != CLAIM_FORMAT)
                     | ~F.col("d.kind").eqNullSafe(CLAIM_KIND), "format or kind")
               .when(~F.col("d.claim_id").eqNullSafe(F.col("claim_id")), "claim id")
               .when(F.col("d.units").isNull(), "units")
               .when((F.size(F.array_distinct(ids)) != F.size(ids))
                     | F.exists(ids, lambda i: i.isNull() | ~i.rlike(UNIT_ID)), "unit ids")
               .when(F.col("d.summaries").isNull(), "summaries"))
    return documents.withColumn("d", d).withColumn("problem", problem)


def summary_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good documents as (claim_id, unit_id, key, day) and (claim_id, name, text) rows."""
    good = documents.filter("problem IS NULL")
    units = good.select("claim_id", F.explode("d.units").alias("u")).select(
        "claim_id", F.col("u.id").alias("unit_id"), F.col("u.key").alias("key"), "u.links")
    texts = good.select("claim_id", F.explode("d.summaries").alias("name", "text"))
    return units, texts


def summaries_to_units(units: DataFrame, texts: DataFrame, queue: DataFrame, stamped: DataFrame,
                       live: DataFrame, late: DataFrame) -> DataFrame:
    """Outcome of every claimed unit: landed, skipped, released or refused, with the reason.

    ``late`` holds the keys whose queued record gained a link the claim never saw.
    """
    by = lambda name, key: texts.select(
        "claim_id", F.col("name").alias(key), F.col("text").alias(name))
    joined = (units.join(by("by_id", "unit_id"), ["claim_id", "unit_id"], "left")
              .join(by("by_key", "key"), ["claim_id", "key"], "left")
              .join(stamped.select("key", F.lit(True).alias("is_stamped")), "key", "left")
              .join(queue.select("key", "topic", F.lit(True).alias("is_queued")), "key", "left")
              .join(live.select("key", F.col("claim_id").alias("holder")), "key", "left")
              .join(late.select("key", F.lit(True).alias("is_late")), "key", "left"))
    text = F.coalesce("by_id", "by_key")
    problem = summary_problem(text, F.col("topic"))
    outcome = (F.when(F.col("is_stamped"), "skipped: already on the card")
               .when(F.col("is_queued").isNull(), "skipped: no longer waiting")
               .when(F.col("holder").isNotNull() & (F.col("holder") != F.col("claim_id")),
                     "skipped: taken by another")
               .when(F.col("is_late"), "released: late link")
               .when(F.col("by_id") != F.col("by_key"), "refused: two summaries")
               .when(text.isNull(), "released: none written")
               .otherwise(F.coalesce(F.concat(F.lit("refused: "), problem), F.lit("landed"))))
    return joined.select("claim_id", "unit_id", "key", outcome.alias("outcome"))


def unknown_summaries(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Summaries that name neither a unit id nor a key of their claim."""
    known = units.select("claim_id", F.col("unit_id").alias("name")).unionByName(
        units.select("claim_id", F.col("key").alias("name")))
    return texts.select("claim_id", "name").join(known, ["claim_id", "name"], "left_anti")
