"""Queries over the message store and the fold."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import daybook.plans.fold_blocks  # noqa: F401  (registers the oracle blocks)
from daybook.functions import text as X
from daybook.functions import times as M
from daybook.operators import fold as fo
from daybook.operators import transcripts as tr
from daybook.plans.adapters import SETTINGS, adapt
from daybook.plans.registry import block, query
from daybook.plans.sqltext import norm_handle, redacted, sanitise, shortcode, strip
from daybook.sources import messages as ms


def day_text(name: str = "day"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def micros(name: str, alias: str | None = None):
    return F.unix_micros(name).alias(alias or name)


def stores(spark: SparkSession, base: str) -> tuple[DataFrame, ...]:
    return tuple(adapt(spark, base, n) for n in
                 ("store_message", "store_membership", "store_chat", "store_handle"))


class Frames(dict):
    """Named frames, each built when first asked for: a query plans only what it reads."""

    def __init__(self, ready: dict, makers: dict) -> None:
        super().__init__(ready)
        self._makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._makers[name](self)
        return self[name]


def folded(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The fold plus the frames hung on it."""
    return Frames(fo.fold(adapt(spark, base, "messages"), SETTINGS, shared=True), {
        "contacts": lambda f: adapt(spark, base, "contacts"),
        "linked": lambda f: tr.labels(f["kept"], f["voices"], f["contacts"]),
        "openers": lambda f: tr.openers(f["prepared"]),
        "units": lambda f: tr.unit_records(f["person_days"], f["openers"], f["linked"],
                                           f["contacts"]),
        "unit_links": lambda f: tr.unit_links(f["spoken"], f["linked"])})


# --- scans ------------------------------------------------------------------------------

block("qualified", """
  SELECT *, CASE WHEN date_raw > 100000000000 THEN date_raw // 1000 ELSE date_raw * 1000000 END
    + 978307200000000 AS at_micros FROM store_message
  WHERE date_raw IS NOT NULL AND coalesce(associated_message_type, 0) = 0
    AND coalesce(item_type, 0) = 0""")
block("placed", """
  SELECT q.*, m.chat_id FROM qualified q JOIN store_membership m ON m.message_id = q.rowid""")
_SCAN = f"""
  SELECT p.rowid, c.rowid AS chat_rowid, nullif({strip('c.display_name')}, '') AS chat_name,
    c.style = 43 AS is_group, p.date_raw, p.at_micros AS sent_at, p.is_from_me,
    h.id AS handle_raw, {strip('p.text')} AS text
  FROM placed p JOIN store_chat c ON c.rowid = p.chat_id
  LEFT JOIN store_handle h ON h.rowid = p.handle_id"""


def _scanned(df: DataFrame) -> DataFrame:
    return df.select("rowid", "chat_rowid", "chat_name", "is_group", "date_raw", micros("sent_at"),
                     "is_from_me", "handle_raw", "text")


@query("s1_scan_messages", _SCAN)
def _(spark, base):
    return _scanned(ms.scan_messages(*stores(spark, base)))


@query("s1_scan_messages_between", _SCAN + """
  WHERE p.at_micros >= epoch_us(TIMESTAMP '2024-01-08 12:00:00')
    AND p.at_micros < epoch_us(TIMESTAMP '2024-01-22 00:00:00')""")
def _(spark, base):
    return _scanned(ms.scan_messages(*stores(spark, base), since=datetime(2024, 1, 8, 12),
                                     until=datetime(2024, 1, 22)))


@query("s2_scan_arrivals", """
  SELECT rowid, chat_id AS chat_rowid, date_raw, at_micros AS sent_at FROM placed
  WHERE rowid > 500""")
def _(spark, base):
    message, membership, _, _ = stores(spark, base)
    return ms.scan_arrivals(message, membership, 500).select(
        "rowid", "chat_rowid", "date_raw", micros("sent_at"))


@query("s3_rowid_bounds", """
  SELECT min(CASE WHEN at_micros >= epoch_us(TIMESTAMP '2024-01-20') THEN rowid END) AS low_rowid,
    max(rowid) AS high_rowid FROM placed""")
def _(spark, base):
    message, membership, _, _ = stores(spark, base)
    return ms.rowid_bounds(message, membership, datetime(2024, 1, 20))


@query("s4_count_messages", "SELECT count(*) AS messages FROM placed")
def _(spark, base):
    message, membership, _, _ = stores(spark, base)
    return ms.count_messages(message, membership)


@query("s5_date_range", "SELECT min(at_micros) AS oldest, max(at_micros) AS newest FROM placed")
def _(spark, base):
    message, membership, _, _ = stores(spark, base)
    return ms.date_range(message, membership).select(micros("oldest"), micros("newest"))


@query("s11_sample_recent", """
  SELECT rowid, epoch_us(sent_at) AS sent_at, text FROM messages
  ORDER BY messages.sent_at DESC, date_raw DESC, rowid DESC LIMIT 2000""")
def _(spark, base):
    return ms.sample_recent(adapt(spark, base, "messages")).select(
        "rowid", micros("sent_at"), "text")


# --- row-level jobs -----------------------------------------------------------------------


@query("p1_normalise_time", """
  SELECT rowid, at_micros,
    CAST(CAST(make_timestamp(at_micros - 4 * 3600000000) AS DATE) AS VARCHAR) AS day
  FROM qualified""")
def _(spark, base):
    at = M.instant(F.col("date_raw"))
    return (ms.qualifying(adapt(spark, base, "store_message")).withColumn("at", at)
            .select("rowid", micros("at", "at_micros"),
                    F.date_format(M.local_day(F.col("at"), "-04:00"), "yyyy-MM-dd").alias("day")))


@query("p2_clean_text_columns", f"""
  SELECT r.rowid, nullif({strip('c.display_name')}, '') AS chat_name,
    {strip("replace(text || chr(65532) || ' ', chr(65532), '')")} AS text
  FROM store_rows r JOIN store_chat c ON c.rowid = r.chat_rowid""")
def _(spark, base):
    chat = adapt(spark, base, "store_chat").select(
        F.col("rowid").alias("chat_rowid"), X.clean_label(F.col("display_name")).alias("name"))
    raw = adapt(spark, base, "store_rows").withColumn(
        "text", F.concat("text", F.lit("￼ ")))
    return (raw.join(chat, "chat_rowid").select(
        "rowid", F.col("name").alias("chat_name"), X.clean_body(F.col("text")).alias("text")))


@query("p3_speaker_key", "SELECT rowid, speaker, participant FROM prepared")
def _(spark, base):
    return fo.prepare(adapt(spark, base, "messages"), SETTINGS).select(
        "rowid", "speaker", "participant")


@query("p5_is_shortcode", f"""
  SELECT ident, {shortcode('ident')} AS shortcode, count(*) AS messages FROM canon GROUP BY ALL""")
def _(spark, base):
    return (fo.prepare(adapt(spark, base, "messages"), SETTINGS)
            .groupBy("ident", X.is_shortcode(F.col("ident")).alias("shortcode"))
            .agg(F.count(F.lit(1)).alias("messages")))


@query("p6_valid_identifier", """
  SELECT ident, coalesce(CASE WHEN ident LIKE '%@%'
      THEN regexp_full_match(ident, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')
      ELSE regexp_full_match(ident, '[+][1-9][0-9]{6,14}') END, false) AS valid
  FROM (SELECT DISTINCT ident FROM canon)""")
def _(spark, base):
    return (fo.prepare(adapt(spark, base, "messages"), SETTINGS).select("ident").distinct()
            .withColumn("valid", X.valid_identifier(F.col("ident"))))


@query("x1_normalise_handles", f"""
  SELECT {norm_handle('handle_raw')} AS canonical, count(DISTINCT handle_raw) AS spellings,
    min(handle_raw) AS first_spelling, count(*) AS messages
  FROM (SELECT handle_raw FROM messages
        UNION ALL SELECT replace(replace(handle_raw, '-', ' '), '+1', '1 ') FROM messages)
  GROUP BY 1""")
def _(spark, base):
    raw = adapt(spark, base, "messages").select("handle_raw")
    loose = raw.select(F.replace(F.replace("handle_raw", F.lit("-"), F.lit(" ")),
                                 F.lit("+1"), F.lit("1 ")).alias("handle_raw"))
    # distinct spellings first: the regex work then runs once per spelling, not per message
    spelled = (raw.unionByName(loose).groupBy("handle_raw")
               .agg(F.count(F.lit(1)).alias("messages")))
    return (spelled.groupBy(X.normalise_handle(F.col("handle_raw")).alias("canonical"))
            .agg(F.count("handle_raw").alias("spellings"),
                 F.min("handle_raw").alias("first_spelling"),
                 F.sum("messages").alias("messages")))


@query("x3_sanitise_bodies", f"SELECT conv_id, turn, {sanitise('text')} AS body FROM conversations")
def _(spark, base):
    return adapt(spark, base, "conversations").select(
        "conv_id", "turn", X.sanitise_body(F.col("text")).alias("body"))


@query("x12_local_day_bounds", """
  SELECT CAST(day AS VARCHAR) AS day, epoch_us(CAST(day AS TIMESTAMP)) + 4 * 3600000000 AS since,
    epoch_us(CAST(day + 1 AS TIMESTAMP)) + 4 * 3600000000 AS until, count(*) AS messages
  FROM (SELECT CAST(sent_at - INTERVAL 4 HOUR AS DATE) AS day FROM messages) GROUP BY ALL""")
def _(spark, base):
    day = M.local_day(F.col("sent_at"), "-04:00").alias("day")
    return (adapt(spark, base, "messages").groupBy(day)
            .agg(F.count(F.lit(1)).alias("messages"))
            .select(day_text(), F.unix_micros(M.day_start(F.col("day"), "-04:00")).alias("since"),
                    F.unix_micros(M.day_start(F.date_add("day", 1), "-04:00")).alias("until"),
                    "messages"))


# --- the fold -------------------------------------------------------------------------------


@query("a1_chat_days", """
  SELECT chat_rowid, CAST(day AS VARCHAR) AS day, is_group, chat_name, messages, counterparts,
    epoch_us(first_at) AS first_at FROM chat_day""")
def _(spark, base):
    f = fo.fold(adapt(spark, base, "messages"), SETTINGS)
    people = (fo.counterparts(f["voices"]).groupBy("chat_rowid", "day")
              .agg(F.count(F.lit(1)).alias("counterparts")))
    return (f["chat_days"].join(people, ["chat_rowid", "day"], "left").select(
        "chat_rowid", day_text(), "is_group", "chat_name", "messages",
        F.coalesce("counterparts", F.lit(0)).alias("counterparts"), micros("first_at")))


@query("a2_turn_stats", """
  SELECT chat_rowid, CAST(day AS VARCHAR) AS day, speaker, CAST(sum(opens) AS BIGINT) AS turns,
    count(*) AS messages, epoch_us(min(sent_at)) AS first_at FROM flagged GROUP BY ALL""")
def _(spark, base):
    voice = fo.voices(fo.prepare(adapt(spark, base, "messages"), SETTINGS))
    return (voice.groupBy("chat_rowid", "day", "speaker")
            .agg(F.sum("turns").alias("turns"), F.sum("messages").alias("messages"),
                 F.min("first_at").alias("first_at"))
            .select("chat_rowid", day_text(), "speaker", "turns", "messages", micros("first_at")))


@query("a3_unit_measures", """
  SELECT chat_rowid, CAST(day AS VARCHAR) AS day, senders, speakers, chars, messages, turns,
    my_turns FROM chat_day""")
def _(spark, base):
    return fo.fold(adapt(spark, base, "messages"), SETTINGS)["chat_days"].select(
        "chat_rowid", day_text(), "senders", "speakers", "chars", "messages", "turns", "my_turns")


@query("p4_substance_floor", """
  SELECT chat_rowid, CAST(day AS VARCHAR) AS day, turns, senders, chars FROM kept""")
def _(spark, base):
    return fo.fold(adapt(spark, base, "messages"), SETTINGS)["kept"].select(
        "chat_rowid", day_text(), "turns", "senders", "chars")


_PERSON_DAYS = """
  SELECT key, ident, CAST(day AS VARCHAR) AS day, chats, is_group, turns, their_turns, my_turns,
    messages, chars, direction, outbound FROM person_day"""


def _person_days(spark, base):
    return fo.fold(adapt(spark, base, "messages"), SETTINGS)["person_days"].select(
        "key", "ident", day_text(), "chats", "is_group", "turns", "their_turns", "my_turns",
        "messages", "chars", "direction", "outbound")


@query("a4_person_days", _PERSON_DAYS)
def _(spark, base):
    return _person_days(spark, base)


@query("w3_direction", """
  SELECT ident, direction, count(*) AS days, CAST(sum(their_turns) AS BIGINT) AS their_turns,
    CAST(sum(my_turns) AS BIGINT) AS my_turns FROM person_day GROUP BY ALL""")
def _(spark, base):
    days = fo.fold(adapt(spark, base, "messages"), SETTINGS)["person_days"]
    return days.groupBy("ident", "direction").agg(
        F.count(F.lit(1)).alias("days"), F.sum("their_turns").alias("their_turns"),
        F.sum("my_turns").alias("my_turns"))


@query("a5_unit_records", """
  SELECT key, ident, name, CAST(day AS VARCHAR) AS day, chats, primary_link, direction, turns,
    their_turns, messages, topic, outbound FROM unit""")
def _(spark, base):
    return folded(spark, base)["units"].select(
        "key", "ident", "name", day_text(), "chats", "primary_link", "direction", "turns",
        "their_turns", "messages", "topic", "outbound")


@query("w4_unit_links", "SELECT ident, CAST(day AS VARCHAR) AS day, pos, link FROM unit_link")
def _(spark, base):
    return folded(spark, base)["unit_links"].select(
        "ident", day_text(), F.col("pos").cast("bigint").alias("pos"), "link")


@query("w5_opener", "SELECT chat_rowid, CAST(day AS VARCHAR) AS day, opener FROM opener")
def _(spark, base):
    return tr.openers(fo.prepare(adapt(spark, base, "messages"), SETTINGS)).select(
        "chat_rowid", day_text(), "opener")


@query("x4_topic_lines", f"""
  SELECT k.chat_rowid, CAST(k.day AS VARCHAR) AS day,
    CASE WHEN k.is_group THEN 'Group texts in ' ||
        coalesce(nullif({sanitise('k.chat_name')}, ''), 'an unnamed group')
        || ' (' || k.messages || ' messages)'
      WHEN coalesce(o.opener, '') <> '' THEN 'Texts (' || k.messages || '): ' || o.opener
      ELSE 'Texts (' || k.messages || ')' END AS topic
  FROM chat_day k LEFT JOIN opener o USING (chat_rowid, day)""")
def _(spark, base):
    f = fo.fold(adapt(spark, base, "messages"), SETTINGS)
    return (f["chat_days"].join(tr.openers(f["prepared"]), ["chat_rowid", "day"], "left").select(
        "chat_rowid", day_text(), X.safe_topic(X.topic_line(
            F.col("is_group"), F.col("chat_name"), F.col("messages"),
            F.col("opener"))).alias("topic")))


# --- transcripts ------------------------------------------------------------------------------


def _lines(spark, base):
    f = folded(spark, base)
    return tr.transcript_lines(f["prepared"], f["linked"], f["speakers"], f["contacts"],
                               SETTINGS)


@query("k1_write_transcripts", """
  SELECT link, CAST(day AS VARCHAR) AS day, slice, count(*) AS lines,
    string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS text
  FROM line GROUP BY link, day, slice""")
def _(spark, base):
    return tr.transcript_parts(_lines(spark, base)).select(
        "link", day_text(), "slice", "lines", "text")


@query("k2_transcript_link", """
  SELECT chat_rowid, CAST(day AS VARCHAR) AS day, label, link FROM linked""")
def _(spark, base):
    return folded(spark, base)["linked"].select("chat_rowid", day_text(), "label", "link")


@query("w6_tail_lines", """
  SELECT link, CAST(greatest(max(n) - 40, 0) AS BIGINT) AS cut,
    string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE line_no > n - 40) AS shown
  FROM (SELECT *, count(*) OVER (PARTITION BY link) AS n FROM line) GROUP BY link""")
def _(spark, base):
    f = folded(spark, base)
    return tr.tails(f["prepared"], f["linked"], f["speakers"], f["contacts"], SETTINGS).select(
        "link", "cut", "shown")


@query("t1_message_order", """
  SELECT rowid, chat_rowid, CAST(day AS VARCHAR) AS day, slice,
    row_number() OVER (PARTITION BY chat_rowid, day, slice ORDER BY sent_at, date_raw, rowid) AS pos
  FROM (SELECT *, CAST(floor(epoch_us(sent_at) / 300000000) AS BIGINT) AS slice FROM prepared)""")
def _(spark, base):
    from pyspark.sql import Window as W
    order = W.partitionBy("chat_rowid", "day", "slice").orderBy(*fo.ORDER)
    return fo.prepare(adapt(spark, base, "messages"), SETTINGS).select(
        "rowid", "chat_rowid", day_text(), "slice",
        F.row_number().over(order).cast("bigint").alias("pos"))


@query("x6_redacted_messages", f"SELECT rowid, {redacted('text')} AS body FROM messages")
def _(spark, base):
    from daybook.functions.redaction import redacted_line
    return adapt(spark, base, "messages").select(
        "rowid", redacted_line("text").alias("body"))
