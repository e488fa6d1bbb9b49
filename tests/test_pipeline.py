"""Sinks, streams and registered queries end to end at the smallest scale."""

import datetime as dt
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from daybook.operators import transcripts as tr
from daybook.plans.adapters import SETTINGS, adapt
from daybook.plans.q_messages import folded
from daybook.sources.tables import (
    batch_folders, exists, merge_batches, read_upto, write_batch)
from daybook.streaming import intake as it
from tools.check import TABLES, table_of

BASE = "/root/testdata/sf0.001"
SAMPLE = ("s1_scan_messages", "a4_person_days", "a5_unit_records", "k1_write_transcripts",
          "j7_resolve_identifiers", "m1_decide_with_emit", "w8_review_rank", "k4_land",
          "a20_apply_change_log", "x7_redaction_spans", "st3_stream_person_days",
          "st5_late_data_frozen_queue", "st10_exactly_once_landing", "st7_hold_release")


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, oracle, name):
    df = entry.queries()[name](spark, BASE)
    cur = oracle.execute(entry.oracle_sql()[name])
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_names_are_unique_and_oracles_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_transcripts_rewrite_only_their_days(spark):
    path = tempfile.mkdtemp(prefix="daybook-test-")
    f = folded(spark, BASE)
    parts = tr.transcript_parts(tr.transcript_lines(f["prepared"], f["linked"], f["speakers"],
                                                    f["contacts"], SETTINGS))
    tr.write_transcripts(parts, path)
    before = spark.read.parquet(path).count()
    one = parts.filter(F.col("day") == dt.date(2024, 1, 10)).withColumn("text", F.lit("new\n"))
    tr.write_transcripts(one, path)
    after = spark.read.parquet(path)
    assert after.count() == before
    assert after.filter("day = '2024-01-10' AND text <> 'new\n'").count() == 0


def test_intake_batch_twice_is_once(spark):
    home = it.Home(tempfile.mkdtemp(prefix="daybook-test-"))
    messages = adapt(spark, BASE, "messages")
    today = dt.date(2024, 1, 20)
    for batch in (0, 1, 1, 0):  # the last two are re-runs of what already happened
        part = messages.filter(F.col("rowid") % 2 == batch)
        if batch == 0 and exists(spark, home.path("queue")):
            continue
        it.intake_batch(part, batch, home, SETTINGS, today)
    queue = spark.read.parquet(home.path("queue"))
    assert queue.count() == queue.select("key").distinct().count() > 0
    got = {r.key for r in it.current_person_days(spark, home).collect()}
    whole = folded(spark, BASE)["person_days"].filter(F.col("day") < F.lit(today))
    assert got == {r.key for r in whole.select("key").collect()}
    assert queue.filter(F.col("day") >= F.lit(today)).count() == 0
    report = it.run_report(spark, home).first()
    assert report["rows_scanned"] == messages.count() and report["released"] == 0
    assert report["queued"] == queue.count() <= report["person_days"]
    assert report["links_added"] == spark.read.parquet(home.path("links")).count()


def test_backfill_resumes_and_sets_aside(spark):
    from dataclasses import replace
    home, settings = it.Home(tempfile.mkdtemp(prefix="daybook-test-")), replace(SETTINGS, tranche_days=5)
    messages = adapt(spark, BASE, "messages")
    window = (dt.date(2024, 1, 1), dt.date(2024, 1, 12))
    first = it.run_backfill(messages, home, settings, *window, max_blocks=1)
    assert (first["blocks_read"], first["complete"]) == (1, False)
    again = it.run_backfill(messages, home, settings, *window)
    assert again["resumed_from"] == dt.date(2024, 1, 6) and again["complete"]
    days = spark.read.parquet(it.window_path(home, *window))
    whole = folded(spark, BASE)["person_days"].filter(F.col("day").between(*map(F.lit, window)))
    assert sorted(r.key for r in days.collect()) == sorted(r.key for r in whole.collect())
    it.run_backfill(messages, home, settings, dt.date(2024, 1, 1), dt.date(2024, 1, 20), max_blocks=1)
    other = it.run_backfill(messages, home, settings, *window, max_blocks=1)
    assert other["set_aside"] and other["resumed_from"] == window[0]


def test_two_hundred_batches_are_merged_and_read_the_same(spark):
    home = it.Home(tempfile.mkdtemp(prefix="daybook-test-"))
    path = home.path("days_stored")
    made = [(dt.date(2024, 1, 1 + b % 28), b, b, b, dt.datetime(2024, 1, 1)) for b in range(200)]
    for b in range(200):
        if b % 4 == 0:      # four batches a write keep the test short; each has its own folder
            (spark.createDataFrame([(*made[n], n) for n in range(b, b + 4)],
                                   "day date, rows long, low_rowid long, high_rowid long, "
                                   "newest timestamp, batch long").coalesce(1)
             .write.mode("append").partitionBy("batch").parquet(path))
        if b % 20 == 19:
            merge_batches(spark, path, it._STORED, b)
    merge_batches(spark, path, it._STORED, 199)     # nothing new: the same rows again

    def rows(upto, since=0):
        return sorted((r["batch"], r["rows"]) for r in read_upto(
            spark, path, it._STORED, upto, since).collect())

    assert rows(199) == [(b, b) for b in range(200)]
    assert rows(120, 60) == [(b, b) for b in range(60, 121)]
    assert len(batch_folders(spark, path)) == 0
    assert len(batch_folders(spark, f"{path}.merged/data", "generation")) == 2
    # A merge cut off before its manifest, and one cut off before it has cleaned up.
    for b in (200, 201):
        write_batch(spark.createDataFrame([made[0]], it._STORED), path, b)
    spark.createDataFrame([], it._STORED).write.parquet(f"{path}.merged/data/generation=11")
    assert [b for b, _ in rows(300)] == list(range(202))
    (spark.createDataFrame([made[5]], it._STORED).withColumn("batch", F.lit(5).cast("long"))
     .write.mode("append").partitionBy("batch").parquet(path))
    assert [b for b, _ in rows(300)] == list(range(202))
    merge_batches(spark, path, it._STORED, 201)
    assert [b for b, _ in rows(300)] == list(range(202)) and not batch_folders(spark, path)


def test_an_intake_goes_on_after_its_tables_were_merged(spark, monkeypatch):
    monkeypatch.setattr(it, "MERGE_AFTER", 1)
    home = it.Home(tempfile.mkdtemp(prefix="daybook-test-"))
    messages = adapt(spark, BASE, "messages")
    today = dt.date(2024, 1, 20)
    for batch in range(3):
        it.intake_batch(messages.filter(F.col("rowid") % 3 == batch), batch, home, SETTINGS, today)
        it.merge_tables(home, messages, most=1)
    whole = folded(spark, BASE)["person_days"].filter(F.col("day") < F.lit(today))
    want = {(r["key"], r["turns"], r["messages"]) for r in whole.collect()}
    got = it.current_person_days(spark, home).collect()
    assert {(r["key"], r["turns"], r["messages"]) for r in got} == want and len(got) == len(want)
    queue = read_upto(spark, home.path("queue"), it._UNITS, 9)
    assert queue.count() == queue.select("key").distinct().count() == len(want)
    assert it.run_report(spark, home).first()["rows_scanned"] == messages.count()


def test_a_folder_of_a_batch_is_one_file_whatever_the_number_of_tasks(spark):
    path = tempfile.mkdtemp(prefix="daybook-test-")
    rows = spark.range(2_000).selectExpr("id", "id % 9 AS day").repartition(16)
    write_batch(rows, path, 0, "day")
    files = [f.parent for f in Path(path).rglob("*.parquet")]
    assert len(files) == len(set(files)) == 9
    assert spark.read.parquet(path).select("id").distinct().count() == 2_000


def test_a_drained_stream_keeps_its_state_on_disk(spark):
    from daybook.plans import q_stream as qs
    from daybook.streaming.windows import stream_chat_days
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    days = stream_chat_days(qs.message_stream(spark, BASE), SETTINGS).select("day", "messages")
    out = qs.drain(days, spark)
    assert out.count() > 0 and spark.conf.get(provider) == before
    home = Path(out.inputFiles()[0].removeprefix("file:")).parents[1]
    kept = {f.suffix for f in (home / "checkpoint" / "state").rglob("*") if f.is_file()}
    assert ".zip" in kept and ".delta" not in kept            # as RocksDB leaves it, not a heap map
