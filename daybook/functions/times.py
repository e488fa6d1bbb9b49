"""Column jobs on time: mixed epoch units, local days, windows of days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.config import EPOCH_2001_MICROS, NANOSECOND_THRESHOLD

#: Seconds outside this band cannot be placed on a calendar and become NULL.
_SECONDS_LIMIT = 8_000_000_000


def instant(raw: Column) -> Column:
    """A raw epoch value (seconds or nanoseconds since 2001, told apart by size) as a timestamp.

    Whole-number arithmetic only, so a nanosecond value keeps its microseconds.
    """
    micros = (F.when(raw > NANOSECOND_THRESHOLD, F.call_function("div", raw, F.lit(1000)))
              .when((raw > -_SECONDS_LIMIT) & (raw < _SECONDS_LIMIT), raw * F.lit(1_000_000)))
    return F.timestamp_micros(micros + F.lit(EPOCH_2001_MICROS))


def local_day(ts: Column, zone: str) -> Column:
    """The calendar day of an instant in the configured zone (session zone is UTC)."""
    return F.to_date(ts if zone == "UTC" else F.from_utc_timestamp(ts, zone))


def local_time(ts: Column, zone: str) -> Column:
    return ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)


def day_start(day: Column, zone: str) -> Column:
    """The instant a local day begins; the day after's start is its exclusive end."""
    midnight = day.cast("timestamp")
    return midnight if zone == "UTC" else F.to_utc_timestamp(midnight, zone)


def day_window(spark: SparkSession, first: date, last: date, today: date,
               allow_today: bool = False) -> DataFrame:
    """Every day of an inclusive window, one row each; a reversed or open window is refused."""
    if last < first:
        raise ValueError(f"the window ends ({last}) before it begins ({first})")
    if last > today or (last == today and not allow_today):
        raise ValueError(f"the window must end before today ({today})")
    return spark.sql("SELECT explode(sequence(:first, :last, interval 1 day)) AS day",
                     args={"first": first, "last": last})
