"""Messages → turns → conversation-days → person-days.

The ordered step (who spoke after whom) never puts a whole conversation-day in one task.
Each day is cut into short time slices; turns are counted inside a slice, and a second, much
smaller step over one row per slice and speaker takes back the turn that a slice boundary
split in two.  Everything after that is plain additive aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.config import (I_REACHED_OUT, MUTUAL, OWNER, THEY_REACHED_OUT, UNKNOWN, Settings,
                            listing)
from daybook.functions.text import is_shortcode, normalise_handle, sanitise_body, unit_key
from daybook.functions.times import local_day
from daybook.session import durable

ORDER = ("sent_at", "date_raw", "rowid")


def order_key() -> Column:
    """Chronological order with the raw date, then the row id, breaking ties."""
    return F.struct(*ORDER)


def speaker_key(is_from_me: Column, ident: Column, is_own: Column) -> Column:
    """Who spoke.  The flag decides first: on an outbound row the handle is the recipient."""
    mine = F.coalesce(is_from_me, F.lit(False)) | is_own
    return F.when(mine, F.lit(OWNER)).otherwise(F.coalesce(ident, F.lit(UNKNOWN)))


def prepare(messages: DataFrame, settings: Settings) -> DataFrame:
    """Row-level work, all of it narrow: identity, speaker, local day, slice, body length."""
    own = listing(messages.sparkSession, settings.own_handles).select(
        F.col("ident").alias("_own"))
    is_own = F.col("_own").isNotNull()
    return (messages
            .withColumn("ident", normalise_handle(F.col("handle_raw")))
            .join(own, F.col("ident") == F.col("_own"), "left")
            .withColumn("speaker", speaker_key(F.col("is_from_me"), F.col("ident"), is_own))
            .withColumn("participant", F.when(~is_own, F.col("ident"))).drop("_own")
            .withColumn("day", local_day(F.col("sent_at"), settings.zone))
            .withColumn("slice", F.floor(F.unix_timestamp("sent_at")
                                         / settings.slice_seconds).cast("bigint"))
            .withColumn("chars", F.length(sanitise_body(F.col("text"))).cast("bigint")))


def voices(prepared: DataFrame) -> DataFrame:
    """One row per (chat, day, speaker, participant): turns, messages, characters, first times.

    ``ord`` numbers messages by (slice, place in slice): one whole number that sorts a
    conversation-day as (instant, raw date, row id) does.  Only numbers and flags are aggregated
    (names are grouping keys), so both aggregations are hash aggregations.
    """
    in_slice = W.partitionBy("chat_rowid", "day", "slice").orderBy(*ORDER)
    rows = (prepared.select("chat_rowid", "day", "slice", *ORDER, "speaker", "participant",
                            "chars", "is_group", "chat_name")
            .withColumn("before", F.lag("speaker").over(in_slice))
            .withColumn("after", F.lead("speaker").over(in_slice))
            .withColumn("ord", F.shiftleft(F.col("slice"), 36) + F.row_number().over(in_slice)))
    who = ("speaker", "participant", "is_group", "chat_name")
    per_slice = rows.groupBy("chat_rowid", "day", "slice", *who).agg(
        F.count_if(F.col("before").isNull() | (F.col("before") != F.col("speaker"))).alias("opens"),
        F.max(F.col("before").isNull()).alias("is_head"),
        F.max(F.col("after").isNull()).alias("is_tail"),
        F.count(F.lit(1)).alias("messages"), F.sum("chars").alias("chars"),
        F.min("ord").alias("ord"), F.min("sent_at").alias("first_at"))
    earlier = (W.partitionBy("chat_rowid", "day").orderBy("slice")
               .rangeBetween(W.unboundedPreceding, -1))
    tail = F.last(F.when(F.col("is_tail"), F.col("speaker")), ignorenulls=True).over(earlier)
    joined = F.coalesce(F.col("is_head") & (tail == F.col("speaker")), F.lit(False))
    return (per_slice.withColumn("opens", F.col("opens") - joined.cast("bigint"))
            .groupBy("chat_rowid", "day", *who).agg(
                F.sum("opens").alias("turns"), F.sum("messages").alias("messages"),
                F.sum("chars").alias("chars"), F.min("ord").alias("ord"),
                F.min("first_at").alias("first_at")))


def speakers(voice: DataFrame, settings: Settings) -> DataFrame:
    """One row per (chat, day, speaker), with what the conversation-day needs to know of it."""
    never = listing(voice.sparkSession, settings.never_ingest).select(
        F.col("ident").alias("_never"))
    blocked = F.col("_never").isNotNull()
    return voice.join(never, F.col("participant") == F.col("_never"), "left").groupBy("chat_rowid", "day", "speaker").agg(
        F.sum("turns").alias("turns"), F.sum("messages").alias("messages"),
        F.sum("chars").alias("chars"), F.min("first_at").alias("first_at"),
        F.coalesce(F.max(blocked), F.lit(False)).alias("blocked"),
        F.min(F.struct("ord", "is_group", "chat_name")).alias("head"))


def _day_measures() -> dict[str, Column]:
    """Measures of a conversation-day over its speaker rows, for a GROUP BY or a window."""
    mine = F.col("speaker") == OWNER
    real = ~F.col("speaker").isin(OWNER, UNKNOWN)
    return {
        "head": F.min("head"), "first_at": F.min("first_at"), "turns": F.sum("turns"),
        "my_turns": F.sum(F.when(mine, F.col("turns")).otherwise(0)),
        "my_first": F.min(F.when(mine, F.col("first_at"))),
        "messages": F.sum("messages"), "chars": F.sum("chars"),
        "senders": F.count(F.lit(1)), "speakers": F.count_if(real),
        "real_speakers": F.count_if(real & ~is_shortcode(F.col("speaker"))),
        "blocked": F.max("blocked")}


def _with_head(df: DataFrame, *also: str | Column) -> DataFrame:
    names = [n for n in _day_measures() if n != "head"]
    return df.select("chat_rowid", "day", F.col("head.is_group").alias("is_group"),
                     F.col("head.chat_name").alias("chat_name"), *names, *also)


def chat_days(spoke: DataFrame) -> DataFrame:
    """One row per (chat, day) with everything the floor and the fold look at."""
    return _with_head(spoke.groupBy("chat_rowid", "day").agg(
        *[measure.alias(name) for name, measure in _day_measures().items()]))


def substance_floor(units: DataFrame, settings: Settings) -> DataFrame:
    """The five gates on conversation-days, cheapest first, all ANDed."""
    return units.filter(
        ~F.col("blocked")
        & ((F.col("speakers") == 0) | (F.col("real_speakers") > 0))
        & (F.col("turns") >= settings.min_turns)
        & (F.col("senders") >= settings.min_senders)
        & (F.col("chars") >= settings.min_chars))


def spoken_days(spoke: DataFrame, settings: Settings) -> DataFrame:
    """Each kept conversation-day once per person who SPOKE in it.

    The day's measures are taken over its speaker rows with a window, which needs no join and
    no shuffle beyond the one the speakers were counted with.
    """
    day = W.partitionBy("chat_rowid", "day")
    beside = spoke.select(
        "chat_rowid", "day", "speaker", F.col("turns").alias("their_turns"),
        F.col("first_at").alias("their_first"),
        *[measure.over(day).alias(name) for name, measure in _day_measures().items()])
    kept = substance_floor(_with_head(beside, "speaker", "their_turns", "their_first"), settings)
    return (kept.filter(~F.col("speaker").isin(OWNER, UNKNOWN))
            .withColumnRenamed("speaker", "ident"))


def counterparts(voice: DataFrame) -> DataFrame:
    """Who took part in a conversation-day: first time seen, and first time heard (if ever)."""
    spoke = F.col("speaker") == F.col("participant")
    return (voice.filter(F.col("participant").isNotNull())
            .groupBy("chat_rowid", "day", F.col("participant").alias("ident"))
            .agg(F.min("ord").alias("seen"), F.min(F.when(spoke, F.col("ord"))).alias("spoke")))


def direction(their_turns: Column, my_turns: Column, their_first: Column,
              my_first: Column) -> Column:
    """Who reached out, from that person's turns beside the owner's."""
    return (F.when((their_turns == 0) & (my_turns == 0), MUTUAL)
            .when(their_turns == 0, I_REACHED_OUT)
            .when(my_turns == 0, THEY_REACHED_OUT)
            .when((their_turns > 1) & (my_turns > 1), MUTUAL)
            .when(their_first <= my_first, THEY_REACHED_OUT)
            .otherwise(I_REACHED_OUT))


def person_days(spoken: DataFrame, settings: Settings) -> DataFrame:
    """One row per (person, day); turns of separate chats add up and are never interleaved.

    The floor is applied again: on summed measures it can only drop a short code.
    """
    folded = spoken.groupBy("ident", "day").agg(
        F.count(F.lit(1)).alias("chats"),
        F.every("is_group").alias("is_group"),
        F.sum("turns").alias("turns"), F.sum("their_turns").alias("their_turns"),
        F.sum("my_turns").alias("my_turns"), F.sum("messages").alias("messages"),
        F.sum("chars").alias("chars"),
        F.min("their_first").alias("their_first"), F.min("my_first").alias("my_first"),
        F.max(~F.col("is_group") & (F.col("my_turns") > 0)).alias("outbound"),
        F.min(F.struct((-F.col("their_turns")).alias("rank"), "is_group", "first_at",
                       "chat_rowid", "chat_name", "messages")).alias("primary"))
    return (folded.filter(~is_shortcode(F.col("ident"))
                          & (F.col("turns") >= settings.min_turns)
                          & (F.col("chars") >= settings.min_chars))
            .select("ident", "day", unit_key(F.col("ident"), F.col("day")).alias("key"), "chats",
                    "is_group", "turns", "their_turns", "my_turns", "messages", "chars",
                    direction(F.col("their_turns"), F.col("my_turns"), F.col("their_first"),
                              F.col("my_first")).alias("direction"),
                    "outbound", "primary"))


def fold(messages: DataFrame, settings: Settings, shared: bool = False) -> dict[str, DataFrame]:
    """The whole fold as named frames, each lazily built on the one before.

    With ``shared`` the voices are checkpointed once, for runs in which several branches (labels,
    units, links, reports) hang on them: the messages are then shuffled once, and because a
    checkpoint keeps its distribution by (chat, day) the branches need no shuffle on it either.
    """
    prepared = prepare(messages, settings)
    voice = durable(voices(prepared)) if shared else voices(prepared)
    spoke = speakers(voice, settings)
    days = chat_days(spoke)
    kept = substance_floor(days, settings)
    spoken = spoken_days(spoke, settings)
    return {"prepared": prepared, "voices": voice, "speakers": spoke, "chat_days": days, "kept": kept,
            "spoken": spoken, "person_days": person_days(spoken, settings)}
