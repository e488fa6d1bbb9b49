"""Backfill windows: blocks of days, where to resume, how long it will take."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.config import Settings

# --- fixed values: measured unit costs, seconds --------------------------------------------
TRANSCRIPT_WRITE_S = 0.001
LEDGER_LINE_S = 0.0001
TRANCHE_OVERHEAD_S = 0.1
# --- end of fixed values --------------------------------------------------------------------


def tranche_no(day: Column, first: Column, size: int) -> Column:
    return F.floor(F.date_diff(day, first) / size).cast("bigint")


def tranches(days: DataFrame, size: int) -> DataFrame:
    """Blocks of consecutive days; ``days`` carries day and lo, the window's first day."""
    return (days.groupBy(tranche_no(F.col("day"), F.col("lo"), size).alias("tranche"))
            .agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                 F.count(F.lit(1)).alias("days")))


def resume_from(saved: dict | None, first: date, last: date) -> tuple[date, bool]:
    """First day still to read, and whether another unfinished window was set aside."""
    if not saved:
        return first, False
    same = saved.get("from") == first.isoformat() and saved.get("to") == last.isoformat()
    if not same:
        return first, not saved.get("complete")
    if saved.get("complete"):
        return first, False
    return max(first, date.fromisoformat(saved["next"])), False


def estimate(counts: DataFrame, settings: Settings, read_seconds: float,
             pause_seconds: float = 0.0) -> DataFrame:
    """Projected seconds and mornings from a dry run's counts (threads, person_days, tranches,
    queued)."""
    pauses = F.greatest(F.col("tranches") - 1, F.lit(0)) * pause_seconds
    seconds = (F.lit(read_seconds) + F.col("threads") * TRANSCRIPT_WRITE_S
               + F.col("person_days") * LEDGER_LINE_S + pauses
               + F.col("tranches") * TRANCHE_OVERHEAD_S)
    return counts.select("*", F.ceil(seconds).alias("seconds"),
                         F.ceil(F.col("queued") / settings.max_stamps).alias("mornings"))
