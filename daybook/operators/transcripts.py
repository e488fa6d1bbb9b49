"""Transcripts: labels, links, rendered lines, bounded document parts, tails, openers, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.config import (NO_WORDS, OWNER, TAIL_LINES, UNKNOWN, UNKNOWN_LABEL,
                            UNNAMED_GROUP_LABEL, UNREADABLE, Settings)
from daybook.functions.redaction import redacted_line
from daybook.functions.text import cut_opener, safe_topic, sanitise_body, slug_label, topic_line
from daybook.functions.times import local_time
from daybook.operators.fold import ORDER, counterparts

#: A document part never holds more lines than this, whatever its conversation does.
PART_LINES = 1_000


def _descending() -> list[Column]:
    return [F.col(c).desc() for c in ORDER]


def contact_names(contacts: DataFrame) -> DataFrame:
    """(ident, contact): contact names as one clean line, blank names left out."""
    return contacts.select("ident", F.nullif(sanitise_body(F.col("name")), F.lit(""))
                           .alias("contact")).filter("contact IS NOT NULL")


def labels(kept: DataFrame, voice: DataFrame, contacts: DataFrame) -> DataFrame:
    """The human label of each conversation-day, its slug and the link of its transcript.

    A one-to-one is named after the first participant with a contact name (those who spoke
    before those who did not), else after the first handle.
    """
    people = counterparts(voice).join(contact_names(contacts), "ident", "left")
    first = people.groupBy("chat_rowid", "day").agg(F.min(F.struct(
        F.col("contact").isNull().alias("unnamed"), F.col("spoke").isNull().alias("silent"),
        F.coalesce("spoke", "seen").alias("at"),
        F.coalesce("contact", "ident").alias("label"))).alias("best"))
    group = F.coalesce(F.nullif(sanitise_body(F.col("chat_name")), F.lit("")),
                       F.lit(UNNAMED_GROUP_LABEL))
    label = (F.when(F.col("is_group"), group)
             .otherwise(F.coalesce("best.label", F.lit(UNKNOWN_LABEL))))
    return (kept.join(first, ["chat_rowid", "day"], "left")
            .withColumn("label", label)
            .withColumn("link", transcript_link(F.col("day"), slug_label(label),
                                                F.col("chat_rowid")))
            .drop("best"))


def transcript_link(day: Column, slug: Column, chat: Column) -> Column:
    """``YYYY/YYYY-MM-DD-<slug>-<chat>.txt``; the chat id keeps equal slugs apart."""
    return F.concat(F.date_format(day, "yyyy"), F.lit("/"), F.date_format(day, "yyyy-MM-dd"),
                    F.lit("-"), slug, F.lit("-"), chat.cast("string"), F.lit(".txt"))


def transcript_lines(prepared: DataFrame, linked: DataFrame, spoke: DataFrame,
                     contacts: DataFrame, settings: Settings, *keep: str) -> DataFrame:
    """Every message of the linked conversation-days as one redacted line.

    Names and links meet at (chat, day, speaker) first, so the messages are joined once and on a
    key that spreads.  The owner and the unknown, who have no contact and are most of the rows,
    stay out of the join on the speaker alone.
    """
    present = (spoke.select("chat_rowid", "day", "speaker")
               .join(linked.select("chat_rowid", "day", "link"), ["chat_rowid", "day"]))
    nobody = F.col("speaker").isin(OWNER, UNKNOWN)
    names = (present.filter(~nobody).join(
        contact_names(contacts).withColumnRenamed("ident", "speaker"), "speaker", "left")
        .unionByName(present.filter(nobody).withColumn("contact", F.lit(None).cast("string"))))
    named = prepared.join(names, ["chat_rowid", "day", "speaker"])
    who = (F.when(F.col("speaker") == OWNER, "Me")
           .otherwise(F.coalesce("contact", "ident", F.lit("Unknown"))))
    shown = (F.when(F.col("text").isNull(), UNREADABLE).otherwise(F.coalesce(
        F.nullif(redacted_line("text"), F.lit("")), F.lit(NO_WORDS))))
    clock = F.date_format(local_time(F.col("sent_at"), settings.zone), "HH:mm")
    return named.select("chat_rowid", "day", "link", "slice", *ORDER, *keep,
                        F.concat(clock, F.lit("  "), who, F.lit(": "), shown).alias("line"))


def transcript_parts(lines: DataFrame) -> DataFrame:
    """Documents as ordered parts: a transcript is its parts in (slice, part) order.

    A part is a time slice, cut again every thousand lines, so the text gathered into one row
    is bounded even when one conversation holds most of the data.
    """
    in_slice = W.partitionBy("chat_rowid", "day", "slice").orderBy(*ORDER)
    numbered = lines.withColumn("pos", F.row_number().over(in_slice))
    return (numbered.withColumn("part", F.floor((F.col("pos") - 1) / PART_LINES).cast("bigint"))
            .groupBy("chat_rowid", "day", "slice", "part").agg(
                F.min("link").alias("link"), F.count(F.lit(1)).alias("lines"),
                F.concat(F.array_join(F.transform(
                    F.sort_array(F.collect_list(F.struct("pos", "line"))),
                    lambda x: x["line"]), "\n"), F.lit("\n")).alias("text")))


def write_transcripts(parts: DataFrame, path: str) -> None:
    """Overwrite exactly the day partitions present in ``parts``; the rest stay untouched."""
    (parts.withColumn("year", F.year("day")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("year", "day").parquet(path))


def tails(prepared: DataFrame, linked: DataFrame, spoke: DataFrame, contacts: DataFrame,
          settings: Settings, keep: int = TAIL_LINES) -> DataFrame:
    """The last ``keep`` lines of each transcript and how many earlier lines were cut.

    The rows are chosen on their keys alone; only those kept are joined with their bodies,
    redacted and rendered.  Slices are cut to ``keep`` rows first, so the second numbering sees a
    bounded group.
    """
    in_slice = W.partitionBy("chat_rowid", "day", "slice").orderBy(*_descending())
    in_day = W.partitionBy("chat_rowid", "day").orderBy(*_descending())
    last = (prepared.select("chat_rowid", "day", "slice", *ORDER)
            .withColumn("back", F.row_number().over(in_slice)).filter(F.col("back") <= keep)
            .withColumn("back", F.row_number().over(in_day)).filter(F.col("back") <= keep)
            .select("chat_rowid", "rowid", "back"))
    rows = prepared.join(last, ["chat_rowid", "rowid"])
    totals = spoke.groupBy("chat_rowid", "day").agg(F.sum("messages").alias("lines"))
    return (transcript_lines(rows, linked, spoke, contacts, settings, "back")
            .groupBy("chat_rowid", "day").agg(
                F.min("link").alias("link"),
                F.array_join(F.transform(F.sort_array(
                    F.collect_list(F.struct((-F.col("back")).alias("at"), "line"))),
                    lambda x: x["line"]), "\n").alias("shown"))
            .join(totals, ["chat_rowid", "day"])
            .withColumn("cut", F.greatest(F.col("lines") - keep, F.lit(0))).drop("lines"))


def openers(prepared: DataFrame) -> DataFrame:
    """First message of each conversation-day that carries words, redacted, then cut.

    The first instant is a hash aggregate of a plain value; only rows of that instant, few and
    mostly one, are compared with their bodies.  Redaction never turns words into nothing, so
    only the one row per conversation-day is redacted.
    """
    worded = prepared.filter(F.col("chars") > 0).select("chat_rowid", "day", *ORDER, "text")
    first = worded.groupBy("chat_rowid", "day").agg(F.min("sent_at").alias("sent_at"))
    chosen = (worded.join(first.hint("shuffle_hash"), ["chat_rowid", "day", "sent_at"])
              .groupBy("chat_rowid", "day").agg(F.min(F.struct(*ORDER, "text")).alias("first")))
    return chosen.select("chat_rowid", "day",
                         cut_opener(redacted_line("first.text")).alias("opener"))


def unit_links(spoken: DataFrame, linked: DataFrame) -> DataFrame:
    """The ordered transcript links of each person-day as rows, the primary conversation first."""
    order = W.partitionBy("ident", "day").orderBy(
        F.col("their_turns").desc(), "is_group", "first_at", "chat_rowid")
    return (spoken.join(linked.select("chat_rowid", "day", "link"), ["chat_rowid", "day"])
            .select("ident", "day", F.row_number().over(order).alias("pos"), "link"))


def unit_records(person_days: DataFrame, opener: DataFrame, linked: DataFrame,
                 contacts: DataFrame) -> DataFrame:
    """The queueable row of each person-day: measures, name, primary link, mechanical topic."""
    primary = person_days.select(
        "*", F.col("primary.chat_rowid").alias("chat_rowid"),
        F.col("primary.is_group").alias("primary_group"),
        F.col("primary.chat_name").alias("primary_name"),
        F.col("primary.messages").alias("primary_messages")).drop("primary")
    topic = safe_topic(topic_line(F.col("primary_group"), F.col("primary_name"),
                                  F.col("primary_messages"), F.col("opener")))
    return (primary.join(opener, ["chat_rowid", "day"], "left")
            .join(linked.select("chat_rowid", "day", "link"), ["chat_rowid", "day"], "left")
            .join(contacts.select("ident", "name"), "ident", "left")
            .select("key", "ident", "name", "day", "chats", F.col("link").alias("primary_link"),
                    "direction", "turns", "their_turns", "messages", topic.alias("topic"),
                    "outbound"))
