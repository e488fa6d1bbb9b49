"""Arrival-driven intake: late data reopens the days it touches, and nothing is too late.

Every micro-batch appends its rows to the store, finds the closed days they touch and folds
those days again in full.  Tables are written so that a batch that runs twice leaves what it
left the first time: everything goes to the batch's own partition, and each batch compares
itself with earlier batches only.  A day folded again is replaced whole: readers take each day
from the last batch that read it, so a day that no longer holds anybody reads as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.config import Settings
from daybook.functions.text import unit_key
from daybook.functions.times import day_start, local_day
from daybook.operators import fold as fo
from daybook.operators.backfill import resume_from
from daybook.operators.landing import landing_outcomes
from daybook.sources.tables import batch_folders, merge_batches, read_upto, write_batch


@dataclass(frozen=True)
class Home:
    """Where one intake keeps its tables."""

    base: str

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"


def _table(columns: str) -> T.StructType:
    """A schema from ``name type`` pairs; unlike DDL it needs no session."""
    types = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
             "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, types[kind]) for name, kind in pairs])


_STORED = _table("day date, rows long, low_rowid long, high_rowid long, "
                               "newest timestamp")
_READ = _table("day date, folded boolean")
_QUEUE_KEY = _table("key string, day date")
_LINK = _table("key string, chat_rowid long, day date")

_COUNTED = T.StructType([T.StructField("counter", T.StringType()), T.StructField("n", T.LongType())])
#: What a run reports, by the stage that counts it.
COUNTERS = {"intake": ("rows_scanned", "rows_open_day", "days_read", "days_left", "person_days",
                       "queued", "links_added"),
            "release": ("released", "already_queued", "owner_skipped")}

#: Batches of one life of the source are numbered from here on; a rebuilt source starts another.
GENERATION = 1 << 32


class Counts:
    """Counters taken while tables are written: no second scan, nothing but the sums at the driver."""

    def __init__(self) -> None:
        self.seen: list[Observation] = []

    def watch(self, df: DataFrame, **counters: Column) -> DataFrame:
        """``df`` that counts ``counters`` when it is written."""
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *[c.alias(name) for name, c in counters.items()])

    def watcher(self, **counters: Column) -> Callable[[DataFrame], DataFrame]:
        """What ``write_batch`` watches its rows with, after any shuffle that writing takes."""
        return lambda df: self.watch(df, **counters)

    def save(self, spark: SparkSession, home: Home, stage: str, number: int) -> None:
        """One row a counter; a batch done again replaces its own."""
        rows = [(name, n) for seen in self.seen for name, n in seen.get.items()]
        write_batch(spark.createDataFrame(rows, _COUNTED).coalesce(1),
                    home.path(f"report/{stage}"), number)


def intake_batch(batch: DataFrame, batch_id: int, home: Home, settings: Settings,
                 today: date, generation: int = 0, first_day: date | None = None) -> None:
    """One micro-batch: store, closed days not read yet, re-fold, frozen queue, grown links.

    Rows of the open day are stored and wait: a day is read by the first batch that finds it
    closed, whether or not that batch brings rows of it.  What decides is a small table of
    days per batch: a day is due when it is closed and no batch has read it since it last got
    rows.  Days before ``first_day`` are set aside unread, as a first run does.
    """
    spark = batch.sparkSession
    number, since = generation * GENERATION + batch_id, generation * GENERATION
    counts, every = Counts(), F.count(F.lit(1))
    rows = batch.withColumn("day", local_day(F.col("sent_at"), settings.zone))
    write_batch(rows, home.path("store"), number, "day", watch=counts.watcher(
        rows_scanned=every, rows_open_day=F.count_if(F.col("day") >= F.lit(today))))
    stored = read_upto(spark, home.path("store"), _without_day(batch, spark), number, number)
    write_batch(stored.groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"), F.min("rowid").alias("low_rowid"),
        F.max("rowid").alias("high_rowid"), F.max("sent_at").alias("newest")),
        home.path("days_stored"), number)
    got = (read_upto(spark, home.path("days_stored"), _STORED, number, since)
           .filter(F.col("day") < F.lit(today)).groupBy("day").agg(F.max("batch").alias("got")))
    read = (read_upto(spark, home.path("days_read"), _READ, number - 1)
            .groupBy("day").agg(F.max("batch").alias("read")))
    due = got.join(read, "day", "left").filter("read IS NULL OR read < got").select(
        "day", (F.col("day") >= F.lit(first_day) if first_day else F.lit(True)).alias("folded"))
    write_batch(due, home.path("days_read"), number, watch=counts.watcher(
        days_read=F.count_if("folded"), days_left=F.count_if(~F.col("folded"))))
    touched = (read_upto(spark, home.path("days_read"), _READ, number, number)
               .filter("folded").select("day"))
    # Everything below is partitioned by day, so the touched days prune what is read.
    again = (read_upto(spark, home.path("store"), _without_day(batch, spark), number, since)
             .join(touched, "day", "left_semi").drop("day", "batch"))
    f = fo.fold(again, settings)
    units = f["person_days"].drop("primary")
    write_batch(units, home.path("person_days"), number, "day",
                watch=counts.watcher(person_days=every))
    fresh = read_upto(spark, home.path("person_days"), units.schema, number, number).drop("batch")
    queued = (read_upto(spark, home.path("queue"), _QUEUE_KEY, number - 1)
              .join(touched, "day", "left_semi"))
    unseen = fresh.join(queued.select("key"), "key", "left_anti")
    write_batch(unseen, home.path("queue"), number, "day", watch=counts.watcher(queued=every))
    links = f["spoken"].select(unit_key(F.col("ident"), F.col("day")).alias("key"), "chat_rowid",
                               "day").join(fresh.select("key"), "key", "left_semi")
    have = (read_upto(spark, home.path("links"), _LINK, number - 1)
            .join(touched, "day", "left_semi"))
    grown = links.join(have, ["key", "chat_rowid"], "left_anti")
    write_batch(grown, home.path("links"), number, "day", watch=counts.watcher(links_added=every))
    counts.save(spark, home, "intake", number)


def release_batch(held: DataFrame, resolved: DataFrame, batch_id: int, home: Home,
                  stamped: DataFrame, queue: DataFrame, owners: DataFrame) -> None:
    """Append the held days of identifiers that resolve now, counting what is not released.

    A day whose key is stamped or queued is counted as already there, one of the owner as skipped.
    """
    known = stamped.select("key").unionByName(queue.select("key")).distinct().withColumn(
        "_known", F.lit(True))
    own = owners.select("person_id").distinct().withColumn("_own", F.lit(True))
    found = resolved.filter("person_id IS NOT NULL").select("ident", "person_id").distinct()
    went = (F.when(F.col("_own"), "owner_skipped").when(F.col("_known"), "already_queued")
            .otherwise("released"))
    days = (held.select("key", "ident", "day").join(found, "ident").join(own, "person_id", "left")
            .join(known, "key", "left").withColumn("_went", went))
    counts = Counts()
    watched = counts.watch(days, **{c: F.count_if(F.col("_went") == c) for c in COUNTERS["release"]})
    write_batch(watched.filter("_went = 'released'").select("key", "ident", "person_id", "day"),
                home.path("released"), batch_id)
    counts.save(held.sparkSession, home, "release", batch_id)


def run_report(spark: SparkSession, home: Home) -> DataFrame:
    """One row: every counter of ``COUNTERS`` over all batches, 0 where a stage never ran."""
    rows = [read_upto(spark, home.path(f"report/{stage}"), _COUNTED, _ANY) for stage in COUNTERS]
    names = [name for stage in COUNTERS.values() for name in stage]
    return rows[0].union(rows[1]).agg(*[
        F.coalesce(F.sum(F.when(F.col("counter") == name, F.col("n"))), F.lit(0)).alias(name)
        for name in names])


def _without_day(batch: DataFrame, spark: SparkSession) -> T.StructType:
    """The store's columns: the batch's own and the day it is partitioned by."""
    return T.StructType([*batch.schema.fields, T.StructField("day", T.DateType())])


_UNITS = _table("ident string, day date, key string, chats long, is_group boolean, turns long, "
                "their_turns long, my_turns long, messages long, chars long, direction string, "
                "outbound boolean")
_ANY = (1 << 63) - 1


def current_person_days(spark: SparkSession, home: Home) -> DataFrame:
    """Each day as the last batch that folded it left it; none before the first closed day."""
    last = (read_upto(spark, home.path("days_read"), _READ, _ANY).filter("folded").groupBy("day")
            .agg(F.max("batch").alias("batch")))
    return read_upto(spark, home.path("person_days"), _UNITS, _ANY).join(last, ["day", "batch"])


_MARK = _table("watermark long, high long, rows_open_day long, "
                             "newest_read_at timestamp, generation int")


def save_progress(spark: SparkSession, home: Home, mark: DataFrame, generation: int = 0) -> None:
    """Append the one-row mark as a new version, last of all; older versions stay readable."""
    before = newest_mark(spark, home)
    version = 0 if before is None else before["batch"] + 1
    write_batch(mark.withColumn("generation", F.lit(generation)).coalesce(1),
                home.path("progress"), version)


def newest_mark(spark: SparkSession, home: Home) -> dict | None:
    """The last complete version of the mark, or nothing before the first run."""
    rows = read_upto(spark, home.path("progress"), _MARK, GENERATION)
    top = rows.orderBy(F.desc("batch")).first()
    return None if top is None else top.asDict()


def progress_row(messages: DataFrame, settings: Settings, today: date) -> DataFrame:
    """Where the mark stands: just under the lowest row of the open day, else the highest row."""
    opened = local_day(F.col("sent_at"), settings.zone) >= F.lit(today)
    return messages.agg(
        F.coalesce(F.min(F.when(opened, F.col("rowid"))) - 1, F.max("rowid")).alias("watermark"),
        F.max("rowid").alias("high"),
        F.count_if(opened).alias("rows_open_day"),
        F.max(F.when(~opened, F.col("sent_at"))).alias("newest_read_at"))


def stored_progress(spark: SparkSession, home: Home, today: date, generation: int) -> DataFrame:
    """The same mark from the table of stored days, which stays small."""
    days = read_upto(spark, home.path("days_stored"), _STORED,
                     (generation + 1) * GENERATION - 1, generation * GENERATION)
    opened = F.col("day") >= F.lit(today)
    return days.agg(
        F.coalesce(F.min(F.when(opened, F.col("low_rowid"))) - 1, F.max("high_rowid"),
                   F.lit(0).cast("bigint")).alias("watermark"),
        F.coalesce(F.max("high_rowid"), F.lit(0).cast("bigint")).alias("high"),
        F.coalesce(F.sum(F.when(opened, F.col("rows"))), F.lit(0).cast("bigint"))
        .alias("rows_open_day"),
        F.max(F.when(~opened, F.col("newest"))).alias("newest_read_at"))


def source_reset(bounds: DataFrame, before: int | None) -> DataFrame:
    """Whether the store holds less than a run already read, or nothing was ever read."""
    high, mark = F.col("high_rowid"), F.lit(before).cast("bigint")
    rebuilt = mark.isNotNull() & F.when(high.isNull(), mark > 0).otherwise(high < mark)
    return bounds.select("high_rowid", mark.alias("before"), rebuilt.alias("store_reset"),
                         (mark.isNull() | rebuilt).alias("read_yesterday_only"))


def run_intake(stream: DataFrame, home: Home, settings: Settings, today: date,
               checkpoint: str, bounds: DataFrame | None = None) -> dict:
    """Drain what has arrived through ``foreachBatch``, save the mark and stop.

    A first run, and a run whose source was rebuilt (``bounds`` end below the mark), reads
    yesterday only; older days are left to the backfill.  A rebuilt source is another
    generation: its stream begins anew and its rows are not mixed with those stored before.
    """
    spark = stream.sparkSession
    mark = newest_mark(spark, home)
    before, generation = (None, 0) if mark is None else (mark["high"], mark["generation"])
    reset = bounds is not None and bool(source_reset(bounds, before).first()["store_reset"])
    generation += int(reset)
    first_day = today - timedelta(days=1) if mark is None or reset else None
    query = (stream.writeStream.foreachBatch(
        lambda df, n: intake_batch(df, n, home, settings, today, generation, first_day))
        .option("checkpointLocation", f"{checkpoint}/{generation}")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    if _days_due(spark, home, today, generation):
        # Nothing arrived, but days have closed since: an empty batch reads them.
        last = read_upto(spark, home.path("days_stored"), _STORED, _ANY).agg(
            F.max("batch")).first()[0]
        empty = spark.createDataFrame([], stream.schema)
        intake_batch(empty, last + 1 - generation * GENERATION, home, settings, today, generation,
                     first_day)
    save_progress(spark, home, stored_progress(spark, home, today, generation), generation)
    merge_tables(home, stream)
    return {"before": before, "store_reset": reset, "first_run": mark is None}


#: Batches that a table may hold in folders of their own; with more, a run ends by merging them.
MERGE_AFTER = 50


def merge_tables(home: Home, rows: DataFrame, most: int = MERGE_AFTER) -> None:
    """Merge the batches of every intake table that has more than ``most`` of its own.

    Only between runs, when all batches are complete: none of them will run again.  ``rows`` has
    the columns of the messages stored.
    """
    spark = rows.sparkSession
    tables = {"store": (_without_day(rows, spark), "day"), "days_stored": (_STORED,),
              "days_read": (_READ,), "person_days": (_UNITS, "day"), "queue": (_UNITS, "day"),
              "links": (_LINK, "day"), "report/intake": (_COUNTED,)}
    for table, (schema, *by) in tables.items():
        folders = batch_folders(spark, home.path(table))
        if len(folders) > most:
            merge_batches(spark, home.path(table), schema, folders[-1][1], *by)


def _days_due(spark: SparkSession, home: Home, today: date, generation: int) -> bool:
    """Whether a closed day has rows that no batch has read."""
    got = read_upto(spark, home.path("days_stored"), _STORED, (generation + 1) * GENERATION - 1,
                    generation * GENERATION).filter(F.col("day") < F.lit(today))
    read = read_upto(spark, home.path("days_read"), _READ, (generation + 1) * GENERATION - 1)
    return got.groupBy("day").agg(F.max("batch").alias("got")).join(
        read.groupBy("day").agg(F.max("batch").alias("read")), "day", "left").filter(
        "read IS NULL OR read < got").limit(1).count() > 0


def land_batch(items: DataFrame, batch_id: int, home: Home, stamped: DataFrame, owners: DataFrame,
               cards: DataFrame) -> None:
    """Append each landable line once; what earlier batches wrote counts as already there.

    Of a key that arrives twice in one batch the least row by ``seq`` (or, without one, by all
    its values) lands, so a batch that runs again lands the same line; it replaces its own
    partition.  Of what was written before, only the days at hand are read.
    """
    spark = items.sparkSession
    order = [*(["seq"] if "seq" in items.columns else []),
             *(c for c in items.columns if c not in ("seq", "key"))]
    once = (items.filter("key IS NOT NULL").groupBy("key")
            .agg(F.min(F.struct(*order)).alias("first")).select("key", "first.*").drop("seq")
            .unionByName(items.filter("key IS NULL").drop("seq")))
    shape = _table("key string, person_id string, day date, pointer string")
    written = read_upto(spark, home.path("interactions"), shape, batch_id - 1).drop("batch").join(
        items.select("day").distinct(), "day", "left_semi").select(*shape.names)
    done = stamped.select("key").unionByName(written.select("key")).distinct()
    outcomes = landing_outcomes(once, done, owners, cards, written)
    write_batch(outcomes.filter("outcome = 'stamped'").select("key", "person_id", "day", "pointer"),
                home.path("interactions"), batch_id, "day")


def run_landing(stream: DataFrame, home: Home, stamped: DataFrame, owners: DataFrame,
                cards: DataFrame, checkpoint: str) -> None:
    query = (stream.writeStream.foreachBatch(
        lambda df, n: land_batch(df, n, home, stamped, owners, cards))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def backfill_tranche(messages: DataFrame, home: Home, settings: Settings, first: date, last: date,
                     tranche: int) -> None:
    """Fold one block of days of a window into the block's own partition.

    The block is a range of instants on the stored column, so a scan reads that range only.
    """
    size = settings.tranche_days
    begin = first + timedelta(days=tranche * size)
    end = min(begin + timedelta(days=size), last + timedelta(days=1))
    inside = ((F.col("sent_at") >= day_start(F.lit(begin), settings.zone))
              & (F.col("sent_at") < day_start(F.lit(end), settings.zone)))
    units = fo.fold(messages.filter(inside), settings)["person_days"].drop("primary")
    write_batch(units, window_path(home, first, last), tranche)


def window_path(home: Home, first: date, last: date) -> str:
    return home.path(f"backfill/days/{first}_{last}")


_CURSOR = _table("from string, to string, next string, complete boolean")


def backfill_cursor(spark: SparkSession, home: Home) -> dict | None:
    """The newest version of the saved cursor, or nothing before the first block."""
    top = read_upto(spark, home.path("backfill/cursor"), _CURSOR, GENERATION).orderBy(
        F.desc("batch")).first()
    return None if top is None else top.asDict()


def run_backfill(messages: DataFrame, home: Home, settings: Settings, first: date, last: date,
                 max_blocks: int | None = None) -> dict:
    """Oldest block first, the cursor saved after each; the same window resumes where it stopped.

    The loop runs over blocks of days, not over data.  A block cut off half way is read again and
    replaces its partition.  Another unfinished window is reported as set aside, and the live
    mark is never touched.
    """
    spark = messages.sparkSession
    saved = backfill_cursor(spark, home)
    version = 0 if saved is None else saved["batch"] + 1
    start, set_aside = resume_from(saved, first, last)
    size = settings.tranche_days
    blocks, n = (last - first).days // size + 1, (start - first).days // size
    stop = blocks if max_blocks is None else min(blocks, n + max_blocks)
    for block in range(n, stop):
        backfill_tranche(messages, home, settings, first, last, block)
        following = first + timedelta(days=(block + 1) * size)
        cursor = spark.createDataFrame(
            [(first.isoformat(), last.isoformat(), following.isoformat(), block + 1 >= blocks)],
            _CURSOR)
        write_batch(cursor.coalesce(1), home.path("backfill/cursor"), version + block - n)
    return {"resumed_from": start, "set_aside": set_aside, "blocks_read": stop - n,
            "complete": stop >= blocks}


def run_counters(stream: DataFrame, home: Home, settings: Settings, checkpoint: str) -> None:
    """Drain a message stream and leave one tally row per batch and day."""
    def tally(df: DataFrame, n: int) -> None:
        write_batch(df.groupBy(local_day(F.col("sent_at"), settings.zone).alias("day")).agg(
            F.count(F.lit(1)).alias("rows"), F.count("text").alias("readable")),
            home.path("tally"), n)
    query = (stream.writeStream.foreachBatch(tally).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def counters(spark: SparkSession, home: Home) -> DataFrame:
    """Rows, days and readable bodies over all batches, however many there were."""
    return spark.read.parquet(home.path("tally")).agg(
        F.sum("rows").alias("rows"), F.countDistinct("day").alias("days"),
        F.sum("readable").alias("readable"))
