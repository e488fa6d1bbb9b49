"""The fold as chained streaming aggregates: slices → longer segments → conversation-days → person-days.

Append mode emits a day only once the watermark has passed its end, so the open day is held
back by the engine itself.  Nothing but ten seconds of one conversation are ever gathered as
messages.  They become a segment (who spoke first, who spoke last, sums per speaker), and segments
merge: a speaker who ends one and begins the next has one turn less.  A level merges at most 30, so
a row holds at most 30 times the speakers of its stretch, whatever was written in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.config import OWNER, UNKNOWN, Settings, listing
from daybook.functions.text import is_shortcode, unit_key
from daybook.functions.times import local_time
from daybook.operators.fold import direction, prepare

#: What is gathered as messages, and the longer stretches it is merged to, each of at most 30.
SLICE = "10 seconds"
STRETCHES = ("5 minutes", "2 hours", "1 day")

#: Rows of one slice, ordered, each marked where it opens a turn; one pass over the rows.
_RUNS = """
  transform(rows, (r, i) -> named_struct('speaker', r.speaker, 'first_at', r.sent_at,
    'opens', CASE WHEN i > 0 AND rows[i - 1].speaker = r.speaker THEN 0L ELSE 1L END,
    'chars', r.chars))"""

_PER_SPEAKER = """
  map_from_entries(transform(array_distinct(transform(runs, r -> r.speaker)), s -> struct(s,
    named_struct('turns', aggregate(filter(runs, r -> r.speaker = s), 0L, (n, r) -> n + r.opens),
      'first_at', array_min(transform(filter(runs, r -> r.speaker = s), r -> r.first_at)),
      'messages', cast(size(filter(runs, r -> r.speaker = s)) AS bigint),
      'chars', aggregate(filter(runs, r -> r.speaker = s), 0L, (n, r) -> n + r.chars)))))"""

#: Ordered segments as one.  Maps are merged by key, so the work grows with the speakers present.
_MERGED = """
  aggregate(slice(parts, 2, size(parts)), parts[0], (a, s) -> named_struct('at', a.at,
    'head', a.head, 'tail', s.tail, 'per', map_zip_with(a.per, s.per, (who, x, y) -> named_struct(
      'turns', coalesce(x.turns, 0L) + coalesce(y.turns, 0L)
        - CASE WHEN who = a.tail AND who = s.head THEN 1L ELSE 0L END,
      'first_at', least(x.first_at, y.first_at),
      'messages', coalesce(x.messages, 0L) + coalesce(y.messages, 0L),
      'chars', coalesce(x.chars, 0L) + coalesce(y.chars, 0L)))))"""

_VOICES = """
  transform(map_entries(segment.per), e -> named_struct('speaker', e.key, 'turns', e.value.turns,
    'first_at', e.value.first_at, 'messages', e.value.messages, 'chars', e.value.chars))"""

_BY_TIME = "array_sort(collect_list(segment), (l, r) -> CASE WHEN l.at < r.at THEN -1 ELSE 1 END)"


def _slices(rows: DataFrame) -> DataFrame:
    """``window, chat_rowid, head, blocked, segment`` of every slice of a conversation."""
    gathered = (rows.groupBy(F.window("local_at", SLICE), "chat_rowid").agg(
        F.sort_array(F.collect_list(F.struct("sent_at", "date_raw", "rowid", "speaker", "chars")))
        .alias("rows"),
        F.min(F.struct("sent_at", "date_raw", "rowid", "is_group")).alias("head"),
        F.max("blocked").alias("blocked"))
        .withColumn("runs", F.expr(_RUNS)))
    segment = F.struct(
        F.col("window.start").alias("at"), F.col("runs")[0]["speaker"].alias("head"),
        F.element_at("runs", -1)["speaker"].alias("tail"), F.expr(_PER_SPEAKER).alias("per"))
    return gathered.select("window", "chat_rowid", "head", "blocked", segment.alias("segment"))


def merged(segments: DataFrame, stretch: str) -> DataFrame:
    """The segments of each longer stretch of a conversation as one."""
    parts = segments.groupBy(F.window("window", stretch), "chat_rowid").agg(
        F.expr(_BY_TIME).alias("parts"), F.min("head").alias("head"),
        F.max("blocked").alias("blocked"))
    return parts.select("window", "chat_rowid", "head", "blocked", F.expr(_MERGED).alias("segment"))


def stream_chat_days(messages: DataFrame, settings: Settings, delay: str = "3 days") -> DataFrame:
    """Conversation-days as a stream, with the turn count and each speaker's share."""
    # Windows are cut on the local instant, so a day is the configured zone's; an hour lived
    # twice at a clock change stays well inside the watermark's delay.
    rows = (prepare(messages, settings)
            .withColumn("local_at", local_time(F.col("sent_at"), settings.zone))
            .withWatermark("local_at", delay))
    never = listing(messages.sparkSession, settings.never_ingest).select(
        F.col("ident").alias("_never"))
    rows = rows.join(never, F.col("participant") == F.col("_never"), "left")
    segments = _slices(rows.withColumn("blocked", F.col("_never").isNotNull()))
    for stretch in STRETCHES:
        segments = merged(segments, stretch)
    voiced = segments.withColumn("voices", F.expr(_VOICES))

    def total(field: str):
        return F.aggregate("voices", F.lit(0).cast("bigint"), lambda n, v: n + v[field])

    return voiced.select(
        "window", "chat_rowid", F.to_date("window.start").alias("day"),
        F.col("head.is_group").alias("is_group"), F.col("head.sent_at").alias("first_at"),
        total("turns").alias("turns"), total("messages").alias("messages"),
        total("chars").alias("chars"), F.size("voices").cast("bigint").alias("senders"),
        "blocked", "voices")


def stream_kept(days: DataFrame, settings: Settings) -> DataFrame:
    """The substance floor on streaming conversation-days."""
    real = F.filter("voices", lambda v: ~v["speaker"].isin(OWNER, UNKNOWN))
    return days.withColumn("real", real).filter(
        ~F.col("blocked")
        & ((F.size("real") == 0) | F.exists("real", lambda v: ~is_shortcode(v["speaker"])))
        & (F.col("turns") >= settings.min_turns) & (F.col("senders") >= settings.min_senders)
        & (F.col("chars") >= settings.min_chars))


def stream_person_days(days: DataFrame, settings: Settings) -> DataFrame:
    """Person-days as a stream: a third chained aggregate over the same day window."""
    # The owner's share is read before the voices are dealt out: what stands in one step with
    # ``explode`` is worked out for each of its rows, which then carries all voices of the day.
    mine = F.get(F.filter("voices", lambda v: v["speaker"] == OWNER), 0)
    spoken = (stream_kept(days, settings).select(
        "window", "chat_rowid", "is_group", "turns", "messages", "chars", "real",
        F.coalesce(mine["turns"], F.lit(0).cast("bigint")).alias("my_turns"),
        mine["first_at"].alias("my_first"))
        .withColumn("v", F.explode("real")).drop("real"))
    folded = spoken.groupBy(F.window("window", "1 day"), F.col("v.speaker").alias("ident")).agg(
        F.count(F.lit(1)).alias("chats"), F.sum("turns").alias("turns"),
        F.sum("v.turns").alias("their_turns"), F.sum("my_turns").alias("my_turns"),
        F.sum("messages").alias("messages"), F.sum("chars").alias("chars"),
        F.min("v.first_at").alias("their_first"), F.min("my_first").alias("my_first"))
    day = F.to_date("window.start")
    return folded.filter(~is_shortcode(F.col("ident"))).select(
        unit_key(F.col("ident"), day).alias("key"), "ident", day.alias("day"), "chats", "turns",
        "their_turns", "my_turns", "messages", "chars",
        direction(F.col("their_turns"), F.col("my_turns"), F.col("their_first"),
                  F.col("my_first")).alias("direction"))
