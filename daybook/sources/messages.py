"""The message store: the qualifying relation, incremental scans and its two-aggregate probes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.config import GROUP_STYLE, NANOSECOND_THRESHOLD, SAMPLE_ROWS
from daybook.functions.text import clean_body, clean_label
from daybook.functions.times import instant


def qualifying(message: DataFrame) -> DataFrame:
    """Rows that are words, not reactions or system notes, and carry a date."""
    return message.filter(
        F.col("date_raw").isNotNull()
        & (F.coalesce(F.col("associated_message_type"), F.lit(0)) == 0)
        & (F.coalesce(F.col("item_type"), F.lit(0)) == 0))


def raw_bounds(since: datetime | None, until: datetime | None) -> Column:
    """The half-open window as a test on the raw column, one range per unit.

    Written on the stored value, not on the decoded instant, so it reaches the Parquet scan.
    """
    raw, keep = F.col("date_raw"), F.lit(True)
    for moment, after in ((since, True), (until, False)):
        if moment is None:
            continue
        delta = moment - datetime(2001, 1, 1)
        seconds = delta.days * 86_400 + delta.seconds
        nanos = seconds * 1_000_000_000 + delta.microseconds * 1_000
        first_second = seconds + (1 if delta.microseconds else 0)
        fine, coarse = (raw >= nanos, raw >= first_second) if after else \
            (raw < nanos, raw < first_second)
        keep = keep & (((raw > NANOSECOND_THRESHOLD) & fine)
                       | ((raw <= NANOSECOND_THRESHOLD) & coarse))
    return keep


def scan_messages(message: DataFrame, membership: DataFrame, chat: DataFrame, handle: DataFrame,
                  since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """message ⋈ membership ⋈ chat ⟕ handle: none for a message in no chat, two for two chats.

    Join strategies are left to run-time statistics: ``chat`` and ``handle`` are broadcast when
    they turn out small and shuffled when they do not.
    """
    rows = qualifying(message).filter(raw_bounds(since, until))
    placed = rows.withColumn("sent_at", instant(F.col("date_raw"))).filter("sent_at IS NOT NULL")
    return (placed.join(membership, placed["rowid"] == membership["message_id"])
            .join(chat.select(F.col("rowid").alias("chat_rowid"), F.col("style").alias("chat_style"),
                              clean_label(F.col("display_name")).alias("chat_name")),
                  F.col("chat_id") == F.col("chat_rowid"))
            .join(handle.select(F.col("rowid").alias("handle_rowid"),
                                clean_label(F.col("id")).alias("handle_raw")),
                  F.col("handle_id") == F.col("handle_rowid"), "left")
            .select(placed["rowid"].alias("rowid"), "chat_rowid", "chat_style", "chat_name",
                    (F.col("chat_style") == GROUP_STYLE).alias("is_group"), "date_raw", "sent_at",
                    "is_from_me", "handle_raw", clean_body(F.col("text")).alias("text")))


def placed_rows(message: DataFrame, membership: DataFrame) -> DataFrame:
    """The body-less relation every arrival probe reads: rowid, chat, date, instant."""
    rows = qualifying(message).select("rowid", "date_raw")
    return (rows.join(membership, rows["rowid"] == membership["message_id"])
            .select("rowid", F.col("chat_id").alias("chat_rowid"), "date_raw",
                    instant(F.col("date_raw")).alias("sent_at")))


def scan_arrivals(message: DataFrame, membership: DataFrame, after_rowid: int) -> DataFrame:
    """Rows that arrived after the mark; no bodies, no order."""
    return placed_rows(message.filter(F.col("rowid") > after_rowid), membership)


def rowid_bounds(message: DataFrame, membership: DataFrame, since: datetime) -> DataFrame:
    """Lowest rowid dated at or after ``since`` and the highest of all, in one pass."""
    return placed_rows(message, membership).agg(
        F.min(F.when(F.col("sent_at") >= F.lit(since), F.col("rowid"))).alias("low_rowid"),
        F.max("rowid").alias("high_rowid"))


def count_messages(message: DataFrame, membership: DataFrame) -> DataFrame:
    return placed_rows(message, membership).agg(F.count(F.lit(1)).alias("messages"))


def date_range(message: DataFrame, membership: DataFrame) -> DataFrame:
    """Oldest and newest instant: aggregated on the normalised value, never the raw one."""
    return placed_rows(message, membership).agg(F.min("sent_at").alias("oldest"),
                                                F.max("sent_at").alias("newest"))


def sample_recent(messages: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The newest ``rows`` messages.

    Widening look-back windows only bound the read; the answer is the newest rows either way,
    so this is one top-k, which Spark runs as a per-partition heap.
    """
    return messages.orderBy(F.col("sent_at").desc(), F.col("date_raw").desc(),
                            F.col("rowid").desc()).limit(rows)


