"""Counts and one-row reports over the other operators' frames."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.config import (HEADLINE_MAX, HEALTHY_RATE, ITEM_MAX, NOTHING_NEW, ONE_TO_ONE_STYLE,
                            Settings)
from daybook.functions.text import cap_line, normalise_handle, scrub_line, strip
from daybook.operators.backfill import estimate, tranche_no
from daybook.operators.ranking import number_rows
from daybook.operators.shape import side_by_side


def own_handle_evidence(message: DataFrame, membership: DataFrame, chat: DataFrame,
                        profile: DataFrame) -> DataFrame:
    """Per candidate own handle: messages sent from it, chats on it, chats last addressed to it,
    and whether a profile names it.

    Each source is counted on its raw spelling first (a handful of values), then canonicalised.
    """
    single = chat.filter(F.col("style") == ONE_TO_ONE_STYLE)
    sent = (message.filter("is_from_me").select("rowid", "account")
            .join(membership, F.col("rowid") == F.col("message_id"))
            .join(single.select(F.col("rowid").alias("chat_id")), "chat_id", "left_semi"))

    def tally(df: DataFrame, column: str, kind: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("raw")).agg(F.count(F.lit(1)).alias("n")).select(
            "raw", F.lit(kind).alias("kind"), "n")

    parts = (tally(sent, "account", "messages")
             .unionByName(tally(single, "account_login", "conversations"))
             .unionByName(tally(single, "last_addressed_handle", "addressed"))
             .unionByName(profile.select(F.col("address").alias("raw")).distinct().select(
                 "raw", F.lit("labelled").alias("kind"), F.lit(1).cast("bigint").alias("n"))))
    handle = normalise_handle(F.regexp_replace(strip(F.col("raw")), "^[EePp]:", ""))
    kinds = ["messages", "conversations", "addressed", "labelled"]
    return (parts.withColumn("handle", handle).filter("handle IS NOT NULL")
            .groupBy("handle").pivot("kind", kinds).agg(F.sum("n"))
            .select("handle", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds[:3]],
                    F.col("labelled").isNotNull().alias("labelled")))


def rank_own_handles(evidence: DataFrame) -> DataFrame:
    """Candidates in the order they are offered: most sent from, most chats, most addressed,
    those a profile names first, then by handle."""
    return number_rows(evidence, [F.col("messages").desc(), F.col("conversations").desc(),
                                  F.col("addressed").desc(), F.col("labelled").desc(),
                                  F.col("handle").asc()], "rank")


def decode_health(sample: DataFrame) -> DataFrame:
    """Share of a sample whose body holds words; healthy at nine in ten."""
    readable = F.count_if(F.length(strip(F.col("text"))) > 0)
    return sample.agg(F.count(F.lit(1)).alias("sampled"), readable.alias("readable")).select(
        "sampled", "readable", (F.col("readable") / F.col("sampled")).alias("rate"),
        (F.col("readable") / F.col("sampled") >= HEALTHY_RATE).alias("healthy"))


def coverage_by_month(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.date_format("sent_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("text").alias("with_text"),
        (F.count("text") / F.count(F.lit(1))).alias("share"))


def preview_counts(fold: dict[str, DataFrame], first: date, last: date) -> DataFrame:
    """What a window would yield, both ends included: one row of counts."""
    inside = F.col("day").between(F.lit(first), F.lit(last))
    per_day = fold["prepared"].filter(inside).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    read = per_day.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
                       F.count(F.lit(1)).alias("days_with_texts"))
    chats = fold["chat_days"].filter(inside).agg(F.count(F.lit(1)).alias("chat_days"))
    kept = fold["kept"].filter(inside).agg(F.count(F.lit(1)).alias("kept"))
    per_person = fold["person_days"].filter(inside).groupBy("ident").agg(
        F.count(F.lit(1)).alias("n"))
    people = per_person.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("person_days"),
                            F.count(F.lit(1)).alias("people"))
    return side_by_side(read, chats, kept, people).withColumn("set_aside", F.col("chat_days") - F.col("kept"))


def newest_samples(kept: DataFrame, rows: int = 3) -> DataFrame:
    """The last conversation-days by (day, chat)."""
    return kept.orderBy(F.col("day").desc(), F.col("chat_rowid").desc()).limit(rows)


def backfill_estimate(fold: dict[str, DataFrame], queued: DataFrame, first: date, last: date,
                      settings: Settings, read_seconds: float) -> DataFrame:
    """Counts of a dry run over a window and what a real one would take."""
    inside = F.col("day").between(F.lit(first), F.lit(last))
    threads = fold["spoken"].filter(inside).select("chat_rowid", "day").distinct().agg(
        F.count(F.lit(1)).alias("threads"))
    units = fold["person_days"].filter(inside)
    days = units.agg(F.count(F.lit(1)).alias("person_days"))
    landing = units.join(queued.select("key"), "key", "left_semi").agg(
        F.count(F.lit(1)).alias("queued"))
    counts = side_by_side(threads, days, landing).withColumn(
        "tranches", tranche_no(F.lit(last), F.lit(first), settings.tranche_days) + 1)
    return estimate(counts, settings, read_seconds)


def run_tally(units: DataFrame, decided: DataFrame) -> DataFrame:
    """Days and identifiers per outcome and reason of a run."""
    per_ident = units.groupBy("ident").agg(F.count(F.lit(1)).alias("n"))
    return (per_ident.join(decided.select("ident", "outcome", "reason"), "ident")
            .groupBy("outcome", "reason").agg(F.sum("n").alias("days"),
                                              F.count(F.lit(1)).alias("identifiers")))


def why_nothing(tally: DataFrame) -> DataFrame:
    """One row: days queued, and the plain reason when there are none."""
    days = F.coalesce(F.sum("days"), F.lit(0))
    queued = F.coalesce(F.sum(F.when(F.col("outcome") == "queue", F.col("days"))), F.lit(0))
    held = F.coalesce(F.sum(F.when(F.col("outcome") == "hold", F.col("days"))), F.lit(0))
    return tally.agg(queued.alias("queued"), held.alias("held"), days.alias("days")).select(
        "queued", F.when(F.col("queued") > 0, F.lit(None).cast("string"))
        .when(F.col("days") == 0, "nothing new was read")
        .when(F.col("held") > 0, F.concat(F.col("held").cast("string"),
                                          F.lit(" day(s) are held until their number is known")))
        .otherwise("the rest were the owner's own").alias("why"))


def _many(n: Column, word: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def brief_row(counts: DataFrame) -> DataFrame:
    """One JSON row: a headline and the items behind it, scrubbed and capped.

    ``counts`` is one row: came_in, filed, waiting, review, held_days, failures, oldest_day.
    """
    c = F.col
    parts = F.array_compact(F.array(
        F.when(c("came_in") > 0, F.concat(_many(c("came_in"), "conversation-day"), F.lit(" in"))),
        F.when(c("filed") > 0, F.concat(F.format_number(c("filed"), 0), F.lit(" filed"))),
        F.when(c("waiting") > 0, F.concat(F.format_number(c("waiting"), 0),
                                          F.lit(" waiting for a summary"))),
        F.when(c("review") > 0, F.concat(_many(c("review"), "number"), F.lit(" to review")))))
    headline = F.when(F.size(parts) > 0, F.concat(F.lit("Texts: "), F.array_join(parts, ", "))
                      ).otherwise(NOTHING_NEW)
    items = F.array(
        F.when(c("failures") > 0, F.concat(_many(c("failures"), "day"),
                                           F.lit(" could not be filed and will be tried again."))),
        F.when(c("review") > 0, F.concat(
            _many(c("review"), "number"), F.lit(" on the review list, holding "),
            _many(c("held_days"), "day"), F.lit("."))),
        F.when(c("waiting") > 0, F.concat(
            _many(c("waiting"), "day"), F.lit(" waiting for a summary, the oldest from "),
            F.date_format("oldest_day", "yyyy-MM-dd"), F.lit("."))))
    clean = F.transform(F.array_compact(items), lambda i: cap_line(scrub_line(i), ITEM_MAX))
    return counts.select(F.to_json(F.struct(
        cap_line(scrub_line(headline), HEADLINE_MAX).alias("headline"),
        F.slice(clean, 1, 10).alias("items"))).alias("brief"))
