"""Where one left off with a person: the union of days, its order, its cuts, the open day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.config import ANSWER_CHARS, ANSWER_DAYS
from daybook.operators.fold import counterparts

# --- fixed values: how states sort on one day -----------------------------------------------------
STATES = ("on_card", "waiting", "held")
# --- end of fixed values ------------------------------------------------------------------------------


def answer_union(on_card: DataFrame, queue: DataFrame, held: DataFrame, stamped: DataFrame,
                 ties: DataFrame) -> DataFrame:
    """Every day of every person with its state; stamped keys leave the other two.

    Held days carry no person, so they come in through the identifiers tied to one.
    """
    cols = ("person_id", "key", "day", "summary", "seq")

    def tagged(df: DataFrame, state: str) -> DataFrame:
        return df.select(*cols, F.lit(state).alias("state"))

    waiting = queue.filter("person_id IS NOT NULL").join(stamped.select("key"), "key", "left_anti")
    parked = (held.drop("person_id").join(ties, "ident")
              .join(stamped.select("key"), "key", "left_anti"))
    return tagged(on_card, "on_card").unionByName(tagged(waiting, "waiting")).unionByName(
        tagged(parked, "held"))


def newest_first(entries: DataFrame, limit: int = ANSWER_DAYS) -> DataFrame:
    """The newest ``limit`` entries of each person in answer order, and how many were cut.

    A person has at most one entry per day and state, so the window is bounded by the calendar;
    Spark also limits each partition before the shuffle.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    order = W.partitionBy("person_id").orderBy(F.col("day").desc(), rank, F.col("seq").desc())
    totals = entries.groupBy("person_id").agg(F.count(F.lit(1)).alias("total"))
    return (entries.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit)
            .join(totals, "person_id")
            .withColumn("cut", F.greatest(F.col("total") - limit, F.lit(0))).drop("total"))


def character_budget(shown: DataFrame, total: int = ANSWER_CHARS) -> DataFrame:
    """Which texts of an answer still fit: the first that does not closes it for all later ones.

    ``shown`` carries person_id, pos and link in answer order; lengths only add up, so a running
    sum past the budget stays past it.
    """
    order = (W.partitionBy("person_id").orderBy("pos", "link_pos", "link")
             .rowsBetween(W.unboundedPreceding, 0))
    size = F.length("shown")
    return shown.withColumn("used", F.sum(size).over(order)).withColumn(
        "fits", (size == 0) | (F.col("used") <= total))


def who_on_day(stamped: DataFrame, queue: DataFrame, held: DataFrame,
               day: date | None = None) -> DataFrame:
    """Everyone the ledger holds for a day (or for every day), each with their standing."""
    cols = ("day", "ident", "person_id", "direction", "key")
    on_card = stamped.select(*cols, F.col("topic").alias("summary"), F.lit("on_card").alias("state"))
    waiting = queue.join(stamped.select("key"), "key", "left_anti").select(
        *cols, F.col("topic").alias("summary"), F.lit("waiting").alias("state"))
    parked = held.select("day", "ident", F.lit(None).cast("string").alias("person_id"), "direction",
                         "key", F.lit(None).cast("string").alias("summary"),
                         F.lit("held").alias("state"))
    rows = on_card.unionByName(waiting).unionByName(parked)
    return rows if day is None else rows.filter(F.col("day") == F.lit(day))


def open_day_with(fold: dict[str, DataFrame], today: date) -> tuple[DataFrame, DataFrame]:
    """The still-open day, read live: unblocked conversation-days and who took part in each.

    No floor: an unanswered text this morning is what is asked for.
    """
    days = fold["chat_days"].filter((F.col("day") == F.lit(today)) & ~F.col("blocked"))
    people = counterparts(fold["voices"]).filter(F.col("day") == F.lit(today))
    return days, people.join(days.select("chat_rowid", "day"), ["chat_rowid", "day"]).select(
        "ident", "chat_rowid", "day")
