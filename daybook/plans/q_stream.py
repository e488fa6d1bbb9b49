"""Streaming queries, each replayed over the given tables to completion.

Results go to Parquet under the session's checkpoint folder and are read back from there.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.plans.adapters import ADAPTERS, SETTINGS, adapt
from daybook.plans.fold_blocks import variant
from daybook.plans.q_ledger import items_of, owners_of, state_tables
from daybook.plans.q_messages import day_text, micros
from daybook.plans.registry import block, query
from daybook.session import checkpoint_dir
from daybook.streaming import holds as hd
from daybook.streaming import intake as it
from daybook.streaming import windows as wn

TODAY = date(2024, 1, 29)


def run_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


def message_stream(spark: SparkSession, base: str) -> DataFrame:
    """The messages adapter over a file-source stream of the events table."""
    schema = spark.read.parquet(f"{base}/events.parquet").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .parquet(base))
    rows = spark.sql(_as_query("store_rows", "events"), events=events)
    return spark.sql(_as_query("messages", "store_rows"), store_rows=rows)


def _as_query(name: str, source: str) -> str:
    from daybook.plans.adapters import _dialect
    return _dialect(ADAPTERS[name][1], "spark").replace(f"FROM {source}", f"FROM {{{source}}}")


#: State lies on disk, with a bounded share of memory for all stores of an executor; the default
#: provider holds every row of every stateful step, in two versions, in the executor's heap.
STATE_CONF = {
    "spark.sql.streaming.statefulOperator.checkCorrectness.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "500",
}


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream to the end of what is there, into Parquet, and read the result."""
    home = run_folder(spark)
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        q = (stream.writeStream.format("parquet").option("path", f"{home}/out")
             .option("checkpointLocation", f"{home}/checkpoint").outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


# Days the watermark has passed: every day that ended three days before the newest message.
block("closed_day", """
  SELECT max(sent_at) - INTERVAL 3 DAY AS mark FROM messages""")


@query("st2_closed_days", """
  SELECT chat_rowid, CAST(day AS VARCHAR) AS day, messages, chars FROM chat_day
  WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT mark FROM closed_day)""")
def _(spark, base):
    days = drain(wn.stream_chat_days(message_stream(spark, base), SETTINGS).select(
        "chat_rowid", "day", "messages", "chars"), spark)
    return days.select("chat_rowid", day_text(), "messages", "chars")


@query("st4_stream_turns", """
  SELECT f.chat_rowid, CAST(f.day AS VARCHAR) AS day, speaker, CAST(sum(opens) AS BIGINT) AS turns,
    count(*) AS messages, epoch_us(min(sent_at)) AS first_at
  FROM flagged f WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT mark FROM closed_day) GROUP BY ALL""")
def _(spark, base):
    days = wn.stream_chat_days(message_stream(spark, base), SETTINGS)
    voices = drain(days.select("chat_rowid", "day", F.explode("voices").alias("v")).select(
        "chat_rowid", "day", "v.speaker", "v.turns", "v.messages", "v.first_at"), spark)
    return voices.select("chat_rowid", day_text(), "speaker", "turns", "messages", micros("first_at"))


@query("st3_stream_person_days", """
  SELECT key, ident, CAST(day AS VARCHAR) AS day, chats, turns, their_turns, my_turns, messages,
    chars, direction
  FROM person_day WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT mark FROM closed_day)""")
def _(spark, base):
    days = wn.stream_chat_days(message_stream(spark, base), SETTINGS)
    return drain(wn.stream_person_days(days, SETTINGS), spark).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd"))


# The same fold in a zone five hours behind (all given days lie in its winter).
block("ny_messages", "SELECT * REPLACE (sent_at - INTERVAL 5 HOUR AS sent_at) FROM messages")
variant("ny_", "ny_messages")


@query("st3_stream_local_days", """
  SELECT key, ident, CAST(day AS VARCHAR) AS day, turns, their_turns, my_turns, messages, chars,
    direction
  FROM ny_person_day WHERE CAST(day + 1 AS TIMESTAMP)
    <= (SELECT max(sent_at) - INTERVAL 3 DAY FROM ny_messages)""")
def _(spark, base):
    settings = replace(SETTINGS, zone="America/New_York")
    days = wn.stream_chat_days(message_stream(spark, base), settings)
    return drain(wn.stream_person_days(days, settings), spark).select(
        "key", "ident", day_text(), "turns", "their_turns", "my_turns", "messages", "chars",
        "direction")


# --- arrivals ---------------------------------------------------------------------------------------

block("early_messages", "SELECT * FROM messages WHERE rowid % 5 <> 0")
variant("early_", "early_messages")


def watched_from_empty(spark: SparkSession) -> it.Home:
    """An intake whose run before found an empty store, so that all of history is read."""
    home = it.Home(run_folder(spark))
    nothing = spark.createDataFrame([], "rowid long, sent_at timestamp")
    it.save_progress(spark, home, it.progress_row(nothing, SETTINGS, TODAY).fillna(0))
    return home


def deliver(spark: SparkSession, home: it.Home, rows: DataFrame, today: date, source: str = "a",
            bounds: DataFrame | None = None) -> dict:
    """Drop ``rows`` where the source is watched and run the intake once."""
    path = home.path(f"arrivals/{source}")
    rows.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return it.run_intake(stream, home, SETTINGS, today, home.path("checkpoint"), bounds)


def replay(spark: SparkSession, base: str) -> it.Home:
    """Two deliveries through the intake: four fifths, then a fifth on days already folded."""
    home = watched_from_empty(spark)
    messages = adapt(spark, base, "messages")
    for late in (False, True):
        deliver(spark, home, messages.filter((F.col("rowid") % 5 == 0) == late), TODAY)
    return home


@query("st1_arrival_intake", """
  SELECT key, ident, CAST(day AS VARCHAR) AS day, turns, messages, direction FROM person_day
  WHERE day < DATE '2024-01-29'""")
def _(spark, base):
    return it.current_person_days(spark, replay(spark, base)).select(
        "key", "ident", day_text(), "turns", "messages", "direction")


@query("st1_moving_today", """
  SELECT key, ident, CAST(day AS VARCHAR) AS day, turns, messages, direction FROM person_day
  WHERE day < DATE '2024-01-29'""")
def _(spark, base):
    """Four runs with ``today`` moving: the first holds rows of an open day only, the third
    brings none of the day that has closed since."""
    home, messages = watched_from_empty(spark), adapt(spark, base, "messages")
    day = F.to_date("sent_at")
    for rows, today in ((day == "2024-01-20", date(2024, 1, 20)),
                        (day < "2024-01-20", date(2024, 1, 20)),
                        (day == "2024-01-21", date(2024, 1, 21)),
                        (day > "2024-01-21", TODAY)):
        deliver(spark, home, messages.filter(rows), today)
    return it.current_person_days(spark, home).select(
        "key", "ident", day_text(), "turns", "messages", "direction")


@query("st1_first_run", """
  SELECT key, turns, messages FROM person_day WHERE day = DATE '2024-01-19'""")
def _(spark, base):
    home = it.Home(run_folder(spark))
    deliver(spark, home, adapt(spark, base, "messages"), date(2024, 1, 20))
    return it.current_person_days(spark, home).select("key", "turns", "messages")


@query("st5_late_data_frozen_queue", """
  SELECT p.key, coalesce(e.turns, p.turns) AS turns, coalesce(e.messages, p.messages) AS messages,
    coalesce(e.direction, p.direction) AS direction,
    (SELECT count(DISTINCT chat_rowid) FROM (
       SELECT chat_rowid, ident, day FROM spoken UNION ALL SELECT chat_rowid, ident, day FROM early_spoken) s
     WHERE s.ident = p.ident AND s.day = p.day) AS links
  FROM person_day p LEFT JOIN early_person_day e ON e.key = p.key WHERE p.day < DATE '2024-01-29'""")
def _(spark, base):
    home = replay(spark, base)
    links = spark.read.parquet(home.path("links")).groupBy("key").agg(
        F.count(F.lit(1)).alias("links"))
    return spark.read.parquet(home.path("queue")).join(links, "key").select(
        "key", "turns", "messages", "direction", "links")


block("release_day", """
  SELECT h.key, CASE WHEN h.person_id IN (SELECT person_id FROM owner_t) THEN 'owner'
    WHEN h.key IN (SELECT key FROM stamped_t) OR h.key IN (SELECT key FROM queue_t) THEN 'already'
    ELSE 'released' END AS went
  FROM held_t h WHERE h.person_id IS NOT NULL""")


@query("a6_run_report", """
  SELECT (SELECT count(*) FROM messages) AS rows_scanned,
    (SELECT count(*) FROM prepared WHERE day >= DATE '2024-01-29') AS rows_open_day,
    (SELECT count(DISTINCT day) FROM prepared WHERE day < DATE '2024-01-29' AND rowid % 5 <> 0)
      + (SELECT count(DISTINCT day) FROM prepared WHERE day < DATE '2024-01-29' AND rowid % 5 = 0)
      AS days_read, CAST(0 AS BIGINT) AS days_left,
    (SELECT count(*) FROM early_person_day WHERE day < DATE '2024-01-29') + (SELECT count(*)
      FROM person_day WHERE day IN (SELECT day FROM prepared WHERE rowid % 5 = 0)
        AND day < DATE '2024-01-29') AS person_days,
    (SELECT count(DISTINCT key) FROM (SELECT key, day FROM early_person_day UNION ALL
      SELECT key, day FROM person_day) WHERE day < DATE '2024-01-29') AS queued,
    (SELECT count(DISTINCT (ident, day, chat_rowid)) FROM (
      SELECT s.ident, s.day, s.chat_rowid FROM early_spoken s JOIN early_person_day p
        ON p.ident = s.ident AND p.day = s.day
      UNION ALL SELECT s.ident, s.day, s.chat_rowid FROM spoken s JOIN person_day p
        ON p.ident = s.ident AND p.day = s.day) WHERE day < DATE '2024-01-29') AS links_added,
    (SELECT count(*) FROM release_day WHERE went = 'released') AS released,
    (SELECT count(*) FROM release_day WHERE went = 'already') AS already_queued,
    (SELECT count(*) FROM release_day WHERE went = 'owner') AS owner_skipped""")
def _(spark, base):
    """Two deliveries, then the held days of every identifier that has a card by now."""
    home, f = replay(spark, base), state_tables(spark, base)
    now = f["days"].filter("person_id IS NOT NULL").select("ident", "person_id").distinct()
    for _again in range(2):
        it.release_batch(f["held"], now, 0, home, f["stamped"], f["queue"], owners_of(spark, base))
    return it.run_report(spark, home)


# The source rebuilt: every second row under a new, lower number.
block("rebuilt_messages", """
  SELECT * REPLACE (rowid // 2 AS rowid) FROM messages
  WHERE rowid % 2 = 0 AND sent_at < TIMESTAMP '2024-01-25 00:00:00'""")
variant("rebuilt_", "rebuilt_messages")


def rebuilt(spark: SparkSession, base: str) -> DataFrame:
    return (adapt(spark, base, "messages").filter("rowid % 2 = 0 AND sent_at < '2024-01-25'")
            .withColumn("rowid", F.call_function("div", F.col("rowid"), F.lit(2))))


@query("st6_source_reset", """
  SELECT (SELECT max(rowid) FROM rebuilt_messages) AS high_rowid, max(rowid) AS before,
    (SELECT max(rowid) FROM rebuilt_messages) < max(rowid) AS store_reset,
    (SELECT max(rowid) FROM rebuilt_messages) < max(rowid) AS read_yesterday_only
  FROM messages""")
def _(spark, base):
    home = watched_from_empty(spark)
    deliver(spark, home, adapt(spark, base, "messages"), date(2024, 1, 20))
    bounds = rebuilt(spark, base).agg(F.max("rowid").alias("high_rowid"))
    return it.source_reset(bounds, it.newest_mark(spark, home)["high"])


@query("st6_rebuilt_store", """
  SELECT key, turns, messages FROM rebuilt_person_day WHERE day = DATE '2024-01-24'
  UNION ALL SELECT key, turns, messages FROM person_day WHERE day < DATE '2024-01-20'""")
def _(spark, base):
    """What was read before stays; of the rebuilt store yesterday is read, and only its rows."""
    home = watched_from_empty(spark)
    deliver(spark, home, adapt(spark, base, "messages"), date(2024, 1, 20))
    rows = rebuilt(spark, base)
    deliver(spark, home, rows, date(2024, 1, 25), "b", rows.agg(F.max("rowid").alias("high_rowid")))
    return it.current_person_days(spark, home).select("key", "turns", "messages")


@query("k6_save_progress", """
  SELECT coalesce(min(rowid) FILTER (WHERE day >= DATE '2024-01-29') - 1, max(rowid)) AS watermark,
    max(rowid) AS high, count(*) FILTER (WHERE day >= DATE '2024-01-29') AS rows_open_day,
    epoch_us(max(sent_at) FILTER (WHERE day < DATE '2024-01-29')) AS newest_read_at FROM prepared""")
def _(spark, base):
    """Saved twice; the newest version is read."""
    home, messages = it.Home(run_folder(spark)), adapt(spark, base, "messages")
    it.save_progress(spark, home, it.progress_row(messages.filter("rowid % 2 = 0"), SETTINGS, TODAY))
    it.save_progress(spark, home, it.progress_row(messages, SETTINGS, TODAY))
    mark = it.newest_mark(spark, home)
    return spark.read.parquet(home.path("progress")).filter(
        F.col("batch") == mark["batch"]).select(
        "watermark", "high", "rows_open_day", micros("newest_read_at"))


@query("st10_exactly_once_landing", """
  SELECT key, person_id, '- ' || CAST(day AS VARCHAR) || ' — conversation (' || direction || '): '
    || topic || ' (→ ' || link || ')' AS pointer
  FROM item_t i WHERE key IS NOT NULL AND person_id IS NOT NULL AND NOT contains(link, ')')
    AND key NOT IN (SELECT key FROM stamped_t) AND person_id NOT IN (SELECT person_id FROM owner_t)
    AND person_id IN (SELECT person_id FROM cards)""")
def _(spark, base):
    home = it.Home(run_folder(spark))
    t = state_tables(spark, base)
    items = items_of(t["queue"])
    cards = adapt(spark, base, "cards")
    for _again in range(2):  # the same items delivered twice land once
        items.write.mode("append").parquet(home.path("items"))
        stream = spark.readStream.schema(items.schema).parquet(home.path("items"))
        it.run_landing(stream, home, t["stamped"], owners_of(spark, base), cards,
                       home.path("checkpoint"))
    return spark.read.parquet(home.path("interactions")).select("key", "person_id", "pointer")


@query("st11_resumable_backfill", """
  SELECT key, CAST(day AS VARCHAR) AS day, turns, direction FROM person_day
  WHERE day BETWEEN DATE '2023-12-30' AND DATE '2024-01-28'""")
def _(spark, base):
    home, settings = it.Home(run_folder(spark)), replace(SETTINGS, tranche_days=10)
    messages = adapt(spark, base, "messages")
    window = (date(2023, 12, 30), date(2024, 1, 28))
    it.run_backfill(messages, home, settings, *window, max_blocks=1)
    it.run_backfill(messages, home, settings, *window)
    return spark.read.parquet(it.window_path(home, *window)).select(
        "key", day_text(), "turns", "direction")


# --- keyed state -----------------------------------------------------------------------------------------

ADAPTERS["hold_events"] = (("ledger_days", "ledger_identifiers"), """
  SELECT ident, 'day' AS kind, 1 AS rank, key, CAST(day AS TIMESTAMP) AS at_ts,
    CAST(NULL AS TIMESTAMP) AS until_ts FROM ledger_days
  UNION ALL
  SELECT ident, 'resolved', 0, '', CAST(DATE '1997-01-01' AS TIMESTAMP), CAST(NULL AS TIMESTAMP)
  FROM ledger_identifiers WHERE state = 'accepted'
  UNION ALL
  SELECT ident, 'lease', 2, key, CAST(day AS TIMESTAMP), CAST(day + 30 AS TIMESTAMP)
  FROM ledger_days WHERE seq % 5 = 0""")


block("released_t", """
  SELECT d.ident, d.key, d.seq % 5 = 0 AS leased, greatest(d.day, DATE '1997-01-01') AS queued_on,
    greatest(greatest(d.day, DATE '1997-01-01') + 3,
      CASE WHEN seq % 5 = 0 THEN d.day + 30 ELSE d.day END) AS free_on
  FROM ledger_days d JOIN ledger_identifiers i ON i.ident = d.ident WHERE i.state = 'accepted'""")


#: Identifiers whose state shares a row on average.
BUCKET_IDENTS = 256


def _outcomes(spark, base):
    folder = f"{run_folder(spark)}/events"
    events = adapt(spark, base, "hold_events").withColumnRenamed("at_ts", "at").withColumnRenamed(
        "until_ts", "until")
    events.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    idents = spark.read.schema(events.schema).parquet(folder).select("ident").distinct().count()
    return drain(hd.hold_and_release(stream, SETTINGS.stale_days,
                                     buckets=1 + idents // BUCKET_IDENTS), spark)


@query("st7_hold_release", """
  SELECT ident, key, epoch_us(CAST(queued_on AS TIMESTAMP)) AS at FROM released_t""")
def _(spark, base):
    return _outcomes(spark, base).filter("outcome = 'queued'").select("ident", "key", micros("at"))


@query("st8_staleness_timeout", """
  SELECT ident, key FROM released_t WHERE NOT leased
    AND free_on <= (SELECT max(day) FROM ledger_days)""")
def _(spark, base):
    leased = adapt(spark, base, "ledger_days").filter("seq % 5 = 0").select("key")
    return _outcomes(spark, base).filter("outcome = 'stale'").join(
        leased, "key", "left_anti").select("ident", "key")


@query("st9_lease_expiry", """
  SELECT ident, key FROM released_t WHERE leased
    AND free_on <= (SELECT max(day) FROM ledger_days)""")
def _(spark, base):
    leased = adapt(spark, base, "ledger_days").filter("seq % 5 = 0").select("key")
    return _outcomes(spark, base).filter("outcome = 'stale'").join(
        leased, "key", "left_semi").select("ident", "key")


@query("st12_stream_counters", """
  SELECT count(*) AS rows, count(DISTINCT day) AS days, count(text) AS readable FROM prepared""")
def _(spark, base):
    home = it.Home(run_folder(spark))
    it.run_counters(message_stream(spark, base), home, SETTINGS, home.path("checkpoint"))
    return it.counters(spark, home)
