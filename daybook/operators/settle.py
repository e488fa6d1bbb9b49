"""What a yes or a no on the review list leaves behind: attached numbers, checked matches, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.operators.ranking import number_rows
from daybook.operators.resolve import resolve_identifiers
from daybook.session import durable
from daybook.sources.tables import read_upto, write_batch


def settle_accepts(steps: DataFrame, asked: DataFrame, card_ids: DataFrame, cards: DataFrame,
                   refused: DataFrame, held: DataFrame, stamped: DataFrame, queue: DataFrame,
                   owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with what became of each, and the held days that go to the queue.

    A number with a card to go to is written on it and resolved again, and only such numbers are.
    One that now reaches that card is ``done``: accepted, its way of matching recorded, its days
    released.  One that still does not (another card has it by now) is held as ``cannot_attach``.
    One that the directory refused (``refused``: ident) waits with the state its section had.  A row
    without a card was a new person's: its number waits for the ``second_yes``.

    Held days are counted as queued, already there (stamped or queued) or, on the owner's own card,
    dropped.  ``asked`` gives each identifier's name.  Rows said twice count once.
    """
    yes = durable(
        steps.filter("action = 'accept' AND refusal IS NULL")
        .select("ident", "section", "target").distinct()
        .join(refused.select("ident").distinct().withColumn("_no", F.lit(True)), "ident", "left"))
    attached = yes.filter("target IS NOT NULL AND _no IS NULL")
    written = card_ids.select("ident", "person_id").unionByName(
        attached.select("ident", F.col("target").alias("person_id"))).distinct()
    again = asked.select("ident", "name").join(attached.select("ident"), "ident", "left_semi")
    after = resolve_identifiers(again, written, cards).select(
        "ident", "status", F.col("person_id").alias("reached"), "route")
    found = yes.join(after, "ident", "left")
    done = (F.col("status") == "resolved") & (F.col("reached") == F.col("target"))
    outcome = (F.when(F.col("target").isNull(), "second_yes").when(F.col("_no"), "left_pending")
               .when(done, "done").otherwise("cannot_attach"))
    told = durable(found.withColumn("outcome", outcome).select(
        "ident", "outcome",
        F.when(F.col("outcome") == "done", "accepted")
        .when(F.col("outcome") == "cannot_attach", "held")
        .when((F.col("outcome") == "left_pending") & (F.col("section") != "attach"), "pending")
        .otherwise("attach_pending").alias("new_state"),
        F.when(F.col("outcome") == "cannot_attach", "cannot_attach").alias("hold_reason"),
        F.col("target").alias("person_id"),
        F.when(F.col("outcome") == "done", F.col("route")).alias("match_route")))
    known = stamped.select("key").unionByName(queue.select("key")).distinct().withColumn(
        "_known", F.lit(True))
    own = owners.select("person_id").distinct().withColumn("_own", F.lit(True))
    days = durable(
        held.select("ident", "key")
        .join(told.filter("outcome = 'done'").select("ident", "person_id"), "ident")
        .join(own, "person_id", "left").join(known, "key", "left")
        .select("ident", "key", "person_id", F.when(F.col("_own"), "owner_dropped")
                .when(F.col("_known"), "already").otherwise("queued").alias("went")))
    went = ("queued", "already", "owner_dropped")
    counts = days.groupBy("ident").agg(
        *[F.count_if(F.col("went") == w).alias(w) for w in went])
    updates = told.join(counts, "ident", "left").fillna(0, list(went))
    return updates, days.filter("went = 'queued'").drop("went")


def check_rank(checks: DataFrame, cards: DataFrame) -> DataFrame:
    """Matches to check, numbered apart as ``m1``, ``m2`` …: most days first, then by name."""
    named = (checks.join(cards.select("person_id", F.col("name").alias("person_name")), "person_id",
                         "left").withColumn("days", F.col("filed") + F.col("waiting")))
    order = [F.col("days").desc(), F.lower(F.coalesce("person_name", F.lit(""))).asc(),
             F.col("ident").asc()]
    return number_rows(named, order, "_no").withColumn(
        "label", F.concat(F.lit("m"), F.col("_no").cast("string"))).drop("_no")


def confirmed(checks: DataFrame) -> DataFrame:
    """Checked rows that are right: the record says which person was confirmed."""
    return checks.select("ident", F.col("person_id").alias("match_confirmed"))


def pinned(checks: DataFrame) -> DataFrame:
    """Checked rows that are someone else: dismissed, and pinned to the person they are not."""
    return checks.select(
        "ident", F.lit("dismissed").alias("state"), F.lit("wrong_match").alias("hold_reason"),
        F.col("person_id").alias("match_person"), F.lit(None).cast("bigint").alias("proposal_id"))


def changed_records(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Whole new records of the updated identifiers: columns of ``updates`` are set, NULL included,
    all others stay; an identifier without a record gets one."""
    names = {c: f"_new_{c}" for c in updates.columns if c != "ident"}
    both = updates.withColumnsRenamed(names).join(records, "ident", "left")
    return both.select([F.col(names.get(c, c)).alias(c) for c in records.columns])


def save_records(updates: DataFrame, path: str, version: int) -> None:
    """Append the records as a version of the identifier table; done again, it replaces itself."""
    write_batch(updates, path, version)


def newest_records(spark: SparkSession, path: str, schema: T.StructType,
                   upto: int = (1 << 63) - 1) -> DataFrame:
    """Each identifier as the newest version up to ``upto`` has it.

    A maximum over (version, record) combines map-side, so an identifier with very many versions
    is no hot key.
    """
    rest = [f.name for f in schema.fields if f.name != "ident"]
    rows = read_upto(spark, path, schema, upto)
    newest = rows.groupBy("ident").agg(F.max(F.struct("batch", *rest)).alias("_newest"))
    return newest.select([F.col("ident") if f.name == "ident" else F.col(f"_newest.{f.name}")
                          for f in schema.fields])
