"""Gates in front of a card line: summary rules, line refusals, the landing outcome, staleness."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.config import SUMMARY_MAX, Settings
from daybook.functions.text import ARROW_OPEN, safe_topic, strip, word_text
from daybook.operators.shape import look_up
from daybook.session import durable
from daybook.sources.tables import read_upto, write_batch

# --- fixed values: what a card line may not hold -------------------------------------------
LINE_BREAKS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
CONTROLS = r"[\x00-\x1f\x7f-\x9f‪-‮⁦-⁩]"
TOPIC_PREFIX = r"^(?:group texts(?: in)?|texts)(?: \d+)?(?: messages?)? ?"
# --- end of fixed values -------------------------------------------------------------------


def _inside(haystack: Column, needle: Column) -> Column:
    pad = F.lit(" ")
    return (needle != "") & F.concat(pad, haystack, pad).contains(F.concat(pad, needle, pad))


def summary_problem(summary: Column, topic: Column) -> Column:
    """The first rule a summary breaks, or NULL when it may land."""
    text = strip(summary)
    said, line = word_text(summary), word_text(topic)
    core = F.trim(F.regexp_replace(said, TOPIC_PREFIX, ""))
    return (F.when(summary.isNull(), "not text")
            .when(summary.rlike(LINE_BREAKS), "line break")
            .when(summary.rlike(CONTROLS), "control character")
            .when(text == "", "empty")
            .when(F.length(text) > SUMMARY_MAX, "too long")
            .when(text.contains("—"), "em dash")
            .when(text.rlike(ARROW_OPEN), "link opening")
            .when(text.contains("[mtg:"), "meeting link")
            .when((core == "") | _inside(line, said) | _inside(line, core), "restates the line"))


def line_refusal(day: Column, topic: Column, link: Column) -> Column:
    """Why a line would be lost downstream, or NULL."""
    real = F.try_to_timestamp(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day),
                              F.lit("yyyy-MM-dd")).isNotNull()
    return (F.when(~F.coalesce(F.length(day) == 10, F.lit(False)), "the day is not YYYY-MM-DD")
            .when(~real, "the day is not a calendar date")
            .when(link.contains(")"), "the link holds ')'")
            .when(link.rlike("[\n\r]"), "the link holds a line break")
            .when(topic.rlike(ARROW_OPEN), "the topic opens a link"))


def pointer_line(day: Column, direction: Column, topic: Column, link: Column) -> Column:
    """The exact line a landing writes, used for idempotency."""
    return F.concat(F.lit("- "), day, F.lit(" — conversation ("), direction, F.lit("): "), topic,
                    F.coalesce(F.concat(F.lit(" (→ "), link, F.lit(")")), F.lit("")))


def landing_outcomes(items: DataFrame, stamped: DataFrame, owners: DataFrame, cards: DataFrame,
                     interactions: DataFrame) -> DataFrame:
    """Every item with the outcome the landing gates give it, in gate order.

    All lookups are joins on unique keys; which of them are broadcast is left to run-time sizes.
    """
    topic = safe_topic(F.col("topic"))
    day = F.date_format("day", "yyyy-MM-dd")
    with_line = items.withColumn(
        "pointer", pointer_line(day, F.col("direction"), topic, F.col("link"))).withColumn(
        "refusal", line_refusal(day, topic, F.col("link")))

    def mark(df: DataFrame, on: list[str], name: str) -> DataFrame:
        return df.select(*on).distinct().withColumn(name, F.lit(True))

    seen = (with_line.join(mark(stamped, ["key"], "is_stamped"), "key", "left")
            .withColumn("_pair", F.concat_ws("\x01", "person_id", "pointer")))
    seen = look_up(seen, mark(owners, ["person_id"], "is_owner"), "person_id", "key", "pointer")
    seen = look_up(seen, mark(cards, ["person_id"], "has_card"), "person_id", "key", "pointer")
    present = mark(interactions.withColumn("_pair", F.concat_ws("\x01", "person_id", "pointer")),
                   ["_pair"], "is_present")
    seen = look_up(seen, present, "_pair", "key").drop("_pair")
    outcome = (F.when(F.col("key").isNull(), "no key")
               .when(F.col("is_stamped"), "skipped")
               .when(F.col("person_id").isNull(), "refused: no person")
               .when(F.col("is_owner"), "refused: owner")
               .when(F.col("has_card").isNull(), "failure: no card")
               .when(F.col("refusal").isNotNull(), "failure: refused line")
               .when(F.col("is_present"), "already_present")
               .otherwise("stamped"))
    return seen.withColumn("outcome", outcome).drop("is_stamped", "is_owner", "has_card",
                                                    "is_present")


def limit_landing(outcomes: DataFrame, limit: int) -> DataFrame:
    """Only the first ``limit`` items that would be stamped, in (day, key) order, are; the rest
    of the walk order after the last of them remains for the next run.

    The cut is one (day, key) value found with a distributed top-k, not a global numbering.  The
    outcomes are checkpointed, so finding the cut does not work the gates out twice.
    """
    outcomes = durable(outcomes)
    order = F.struct("day", "key")
    first = (outcomes.filter("outcome = 'stamped'").select(order.alias("at"))
             .orderBy("at").limit(limit))
    cut = first.agg(F.struct(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))).scalar()
    return outcomes.withColumn("cut", cut).withColumn(
        "outcome", F.when((F.col("cut.n") >= limit) & (order > F.col("cut.at")), "remaining")
        .otherwise(F.col("outcome"))).drop("cut")


def stale_due(queue: DataFrame, stamped: DataFrame, live: DataFrame, today: date,
              settings: Settings) -> DataFrame:
    """Queued days old enough to land with their plain line, not stamped and not leased."""
    return (queue.filter(F.col("queued_at").isNotNull()
                         & (F.date_diff(F.lit(today), F.col("queued_at")) >= settings.stale_days))
            .join(stamped.select("key"), "key", "left_anti")
            .join(live.select("key"), "key", "left_anti"))


def first_touch(cards: DataFrame, snapshot: DataFrame, touched: DataFrame) -> DataFrame:
    """Cards to copy before their first backfilled line: touched now, never copied before."""
    return (cards.join(touched.select("person_id").distinct(), "person_id", "left_semi")
            .join(snapshot.select("person_id"), "person_id", "left_anti"))


def copy_first_touch(cards: DataFrame, path: str, touched: DataFrame, run: int) -> None:
    """Add the cards of persons touched for the first time to the table of first copies.

    Insert if absent: a card that an earlier run copied keeps that copy, and a run done again
    replaces its own part with the same rows.
    """
    spark = cards.sparkSession
    write_batch(first_touch(cards, read_upto(spark, path, cards.schema, run - 1), touched), path,
                run)


def land_copied(outcomes: DataFrame, copies: DataFrame) -> DataFrame:
    """No copy, no line: lines of persons whose card was not copied first stay behind."""
    copied = copies.select("person_id").distinct().withColumn("_copied", F.lit(True))
    return (look_up(outcomes, copied, "person_id", "key", "pointer")
            .withColumn("outcome", F.when(
                (F.col("outcome") == "stamped") & F.col("_copied").isNull(), "failure: no copy")
                .otherwise(F.col("outcome"))).drop("_copied"))
