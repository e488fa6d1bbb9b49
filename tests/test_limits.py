"""What once had a cap, a switch or a fixed zone, past its old limit."""

import datetime as dt
import random
import re
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from daybook.config import Settings
from daybook.operators import audit as au
from daybook.operators import fold as fo
from daybook.operators import ledger as lg
from daybook.operators import summaries as sm
from daybook.streaming import intake as it
from daybook.streaming import windows as wn

MESSAGE = ("rowid long, chat_rowid long, is_group boolean, chat_name string, is_from_me boolean, "
           "handle_raw string, sent_at timestamp, date_raw long, text string")
OWN = ("+15559999999",)


def talk(spark, times, step=1):
    """Two people in turn in one chat at the given instants."""
    rows = [(i, 1, False, None, i % (2 * step) >= step, "+15550000001", t, i,
             "words enough to pass the floor") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, MESSAGE)


def streamed(spark, messages, settings):
    """Conversation-days of a stream over the rows, and of one far later row that closes them."""
    folder = tempfile.mkdtemp(prefix="daybook-test-")
    closing = messages.limit(1).withColumn("sent_at", F.lit(dt.datetime(2030, 1, 1)))
    messages.coalesce(1).write.parquet(f"{folder}/in")
    closing.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{folder}/in")
    days = wn.stream_chat_days(stream, settings).select("chat_rowid", "day", "turns", "messages")
    q = (days.writeStream.format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(days.schema).parquet(f"{folder}/out")


def test_five_thousand_blocked_handles(spark):
    blocked = tuple(f"+1666{i:07d}" for i in range(5_000)) + ("+15550000001",)
    messages = talk(spark, [dt.datetime(2024, 1, 5, 12, i) for i in range(6)])
    table = spark.createDataFrame([(h,) for h in blocked], "ident string")
    for never in (blocked, table):
        days = fo.fold(messages, Settings(OWN, never))["chat_days"].collect()
        assert [d["blocked"] for d in days] == [True]
    assert not fo.fold(messages, Settings(table.limit(5)))["chat_days"].first()["blocked"]


def test_claims_do_not_depend_on_partitions(spark):
    queue = spark.range(100).select(
        F.concat(F.lit("k"), F.pmod("id", F.lit(50)), F.lit("-"), "id").alias("key"),
        F.date_add(F.lit("2024-01-01"), F.pmod("id", F.lit(7)).cast("int")).alias("day"))
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = sm.claim_batches(queue, 15).select("batch", "unit_id", "key").collect()
        seen.append(sorted(map(tuple, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and max(r[0] for r in seen[0]) == 6


def test_tallies_of_more_than_a_hundred_batches(spark):
    folder = tempfile.mkdtemp(prefix="daybook-test-")
    messages = talk(spark, [dt.datetime(2024, 1, 1 + i % 9, 1, i % 60) for i in range(210)])
    messages.repartition(105, "rowid").write.option("maxRecordsPerFile", 2).parquet(f"{folder}/in")
    stream = (spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{folder}/in"))
    home = it.Home(folder)
    it.run_counters(stream, home, Settings(OWN), f"{folder}/cp")
    assert spark.read.parquet(home.path("tally")).select("batch").distinct().count() > 100
    assert tuple(it.counters(spark, home).first()) == (210, 9, 210)


def test_streamed_days_follow_the_zone_over_a_clock_change(spark):
    settings = Settings(OWN, zone="America/New_York")
    start = dt.datetime(2024, 3, 9, 20)
    messages = talk(spark, [start + dt.timedelta(minutes=23 * i) for i in range(200)])
    want = fo.fold(messages, settings)["chat_days"].select("day", "turns", "messages")
    got = streamed(spark, messages, settings).filter("day < '2029-01-01'")
    assert (sorted(map(tuple, got.select("day", "turns", "messages").collect()))
            == sorted(map(tuple, want.collect())))


def test_a_hundred_thousand_messages_in_one_day(spark):
    at = F.timestamp_seconds(F.lit(1_704_412_800) + (F.col("id") * 80_000 / 100_000).cast("long"))
    messages = spark.range(100_000).select(
        F.col("id").alias("rowid"), F.lit(1).cast("long").alias("chat_rowid"),
        F.lit(False).alias("is_group"), F.lit(None).cast("string").alias("chat_name"),
        (F.col("id") % 2 == 0).alias("is_from_me"), F.lit("+15550000001").alias("handle_raw"),
        at.alias("sent_at"), F.col("id").alias("date_raw"), F.lit("hello").alias("text"))
    rows = streamed(spark, messages, Settings(OWN)).filter("day < '2029-01-01'").collect()
    assert [(r["turns"], r["messages"]) for r in rows] == [(100_000, 100_000)]


def test_rows_of_a_streamed_day_stay_bounded_by_its_speakers(spark):
    n, speakers = 100_000, 500
    at = F.timestamp_seconds(F.lit(1_704_412_800) + (F.col("id") * 80_000 / n).cast("long"))
    who = F.format_string("+1555%07d", F.pmod(F.xxhash64(F.col("id") * 3 / 5), F.lit(speakers)))
    messages = spark.range(n).select(
        F.col("id").alias("rowid"), F.lit(1).cast("long").alias("chat_rowid"),
        F.lit(True).alias("is_group"), F.lit("talk").alias("chat_name"),
        F.lit(False).alias("is_from_me"), who.alias("handle_raw"), at.alias("sent_at"),
        F.col("id").alias("date_raw"), F.lit("hello").alias("text"))
    settings, held = Settings(OWN), []
    whole = wn.merged

    def watched(segments, stretch):
        gathered = segments.groupBy(F.window("window", stretch), "chat_rowid").agg(
            F.count(F.lit(1)).alias("parts"), F.sum(F.size("segment.per")).alias("entries"))
        held.append(gathered.agg(F.max("parts"), F.max("entries")).first())
        return whole(segments, stretch)

    wn.merged = watched
    try:
        day = wn.stream_chat_days(messages, settings).first()
    finally:
        wn.merged = whole
    assert len(held) == 3 and all(p <= 30 and e <= 30 * speakers for p, e in held)
    want = fo.fold(messages, settings)
    one = want["chat_days"].first()
    assert (day["turns"], day["messages"], day["senders"]) == (
        one["turns"], n, speakers) and day["turns"] < n
    assert sum(v["turns"] for v in day["voices"]) == day["turns"]


def test_segments_merge_like_one_long_run(spark):
    rng = random.Random(9)
    start = dt.datetime(2024, 1, 5)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 0, 1, 3, 9, 40, 400, 900])
        who = rng.choice(["+15550000001", "+15550000002", None])
        rows.append((i, 1, True, "x", who is None, who, start + dt.timedelta(seconds=at), i,
                     "x" * rng.randint(0, 5)))
    messages, settings = spark.createDataFrame(rows, MESSAGE), Settings(OWN)
    got = {(r["day"], v["speaker"]): (v["turns"], v["messages"], v["chars"])
           for r in wn.stream_chat_days(messages, settings).collect() for v in r["voices"]}
    order = fo.prepare(messages, settings).orderBy("sent_at", "date_raw", "rowid").collect()
    want, last = {}, None
    for r in order:
        key = (r["sent_at"].date(), r["speaker"])
        turns, n, chars = want.get(key, (0, 0, 0))
        want[key] = (turns + (key != last), n + 1, chars + r["chars"])
        last = key
    assert got == want and len({d for d, _ in got}) > 1


def test_a_run_id_used_twice_does_not_commit_the_first_stretch(spark):
    log = spark.createDataFrame(
        [(1, 7, 1, "enqueue", "a|day|x", "r"), (2, 7, 1, "stamp_intent", "b|day|x", "r"),
         (5, 7, 5, "enqueue", "c|day|x", "r")],
        "seq long, run long, segment long, op string, key string, record string")
    runs = spark.createDataFrame([(7, 1, False), (7, 5, True)],
                                 "run long, segment long, committed boolean")
    state = {(r["tbl"], r["key"]) for r in lg.apply_change_log(log, runs).collect()}
    assert state == {("stamped", "b|day|x"), ("queue", "c|day|x")}


def test_denied_terms_without_a_letter(spark):
    docs = spark.createDataFrame(
        [(1, "one ### two\nx###"), (2, r"a\Eb and Acme Corp!"), (3, "see /Users/jane/x")],
        "doc_id long, text string")
    terms = spark.createDataFrame([("###",), (r"a\Eb",), ("acme corp",), (" ",)], "term string")
    hits = {tuple(r) for r in au.leak_scan(docs, terms).collect()}
    assert hits == {(1, 0, "denylist: ###"), (2, 0, r"denylist: a\eb"),
                    (2, 0, "denylist: acme corp"), (3, 0, "built-in: home-folder path")}


def leaks(docs, terms, **more):
    return sorted(tuple(r) for r in au.leak_scan(docs, terms, **more).collect())


def test_deny_terms_equal_a_plain_search_whatever_the_slices(spark):
    rng, words = random.Random(3), ["ann", "anna", "lee", "o'neil", "x.y", "é", "٤", "new york", "#"]
    texts = ["\n".join("".join(rng.choice(words) + rng.choice([" ", "-", ".", "", "  "])
                               for _ in range(rng.randint(0, 6))) for _ in range(3))
             for _ in range(200)]
    listed = sorted({rng.choice(words) + rng.choice(["", " ", "-", " lee"]) for _ in range(25)}
                    | {"nobody here", "ann lee", "Ann Lee", "  ANN "})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)],
                                 "doc_id long, text string")
    terms = spark.createDataFrame([(t,) for t in [*listed, None, " "]], "term string")
    want = sorted({(i, n, f"denylist: {t.strip().lower()}") for i, text in enumerate(texts)
                   for n, line in enumerate(text.split("\n")) for t in listed
                   if re.search(rf"(?<![^\W_]){re.escape(t.strip().lower())}(?![^\W_])", line.lower())})
    assert leaks(docs, terms) == want and len(want) > 100
    assert leaks(docs, terms, index_bytes=200) == want


def test_leak_scan_refuses_no_terms_and_lets_named_addresses_pass(spark):
    docs = spark.createDataFrame(
        [(1, "mail Desk@Firm.net now"), (2, "desk@firm.net and me@firm.net"), (3, "a@sub.example.org")],
        "doc_id long, text string")
    terms = spark.createDataFrame([("nobody",)], "term string")
    rule = "built-in: email address"
    assert leaks(docs, terms) == [(1, 0, rule), (2, 0, rule)]
    assert leaks(docs, terms, allowed=["desk@firm.NET"]) == [(2, 0, rule)]
    for none in ([], [(" ",)], [(None,)]):
        with pytest.raises(ValueError, match="empty"):
            au.leak_scan(docs, spark.createDataFrame(none, "term string"))


def test_leak_scan_shuffles_no_text(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    terms = spark.createDataFrame([("two",), ("one two",)], "term string")
    plan = au.leak_scan(docs, terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and plan.count("BroadcastExchange") == 1


def test_open_days_are_read_when_they_close_even_if_nothing_arrives(spark):
    folder = tempfile.mkdtemp(prefix="daybook-test-") + uuid.uuid4().hex
    home, settings = it.Home(folder), Settings(OWN)
    nothing = spark.createDataFrame([], "rowid long, sent_at timestamp")
    it.save_progress(spark, home, it.progress_row(nothing, settings, dt.date(2024, 1, 5)).fillna(0))
    messages = talk(spark, [dt.datetime(2024, 1, 5, 12, i) for i in range(6)])
    messages.write.parquet(f"{folder}/in")
    keys = []
    for today in (dt.date(2024, 1, 5), dt.date(2024, 1, 5), dt.date(2024, 1, 6)):
        stream = spark.readStream.schema(messages.schema).parquet(f"{folder}/in")
        it.run_intake(stream, home, settings, today, f"{folder}/cp")
        keys.append([r["key"] for r in it.current_person_days(spark, home).collect()])
    assert keys == [[], [], ["+15550000001|day|2024-01-05"]]
    assert it.newest_mark(spark, home)["watermark"] == 5


def test_a_batch_without_closed_days_counts_nothing_read(spark):
    home, settings = it.Home(tempfile.mkdtemp(prefix="daybook-test-") + "/h"), Settings(OWN)
    messages = talk(spark, [dt.datetime(2024, 1, 5, 12, i) for i in range(6)])
    it.intake_batch(messages, 0, home, settings, dt.date(2024, 1, 5))
    it.intake_batch(messages.limit(0), 1, home, settings, dt.date(2024, 1, 5))
    report = it.run_report(spark, home).first().asDict()
    assert report == {**dict.fromkeys(report, 0), "rows_scanned": 6, "rows_open_day": 6}
    counters = spark.read.parquet(home.path("report/intake"))
    assert counters.count() == 2 * len(it.COUNTERS["intake"])


def test_a_person_of_a_large_group_is_dealt_out_without_the_others(spark):
    start, speakers = dt.datetime(2024, 1, 5, 8), 150
    rows = [(i, 1, True, "talk", i % 7 == 0, f"+1555{i % speakers:07d}",
             start + dt.timedelta(seconds=61 * i), i, "words enough to pass the floor")
            for i in range(600)]
    messages, settings = spark.createDataFrame(rows, MESSAGE), Settings(OWN)
    days = wn.stream_person_days(wn.stream_chat_days(messages, settings), settings)
    plan = days._jdf.queryExecution().sparkPlan().toString()
    dealt = [line for line in plan.splitlines() if "Generate explode(real" in line]
    assert len(dealt) == 1 and "my_first" in dealt[0] and "voices" not in dealt[0]
    columns = ("key", "chats", "turns", "their_turns", "my_turns", "messages", "chars", "direction")
    want = fo.fold(messages, settings)["person_days"].select(*columns)
    assert sorted(map(tuple, days.select(*columns).collect())) == sorted(
        map(tuple, want.collect())) and want.count() == speakers
