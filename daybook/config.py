"""Scalar knobs of a run and the constants every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: output vocabulary and thresholds ---------------------------------
OWNER = "(me)"
UNKNOWN = "(unknown)"
THEY_REACHED_OUT = "they_reached_out"
I_REACHED_OUT = "i_reached_out"
MUTUAL = "mutual"
NO_WORDS = "[no words]"
UNREADABLE = "[unreadable]"
UNNAMED_GROUP_LABEL = "group"
UNKNOWN_LABEL = "unknown"
GROUP_STYLE = 43
ONE_TO_ONE_STYLE = 45
SHORTCODE_MIN_DIGITS = 7
E164_MAX_DIGITS = 15
NANOSECOND_THRESHOLD = 100_000_000_000
EPOCH_2001_MICROS = 978_307_200_000_000
OPENER_MAX = 80
SLUG_MAX = 60
SUMMARY_MAX = 400
HEADLINE_MAX = 160
ITEM_MAX = 300
TAIL_LINES = 40
ANSWER_CHARS = 12_000
ANSWER_DAYS = 5
SAMPLE_ROWS = 2_000
HEALTHY_RATE = 0.90
LEASE_HOURS = 24
RECENT_DAYS = 7
REOPENED = "re-opened: fresh texts after it was dismissed"
NOTHING_NEW = "Texts: nothing new to file."
# --- end of fixed values --------------------------------------------------------------

@dataclass(frozen=True)
class Settings:
    """What a run is told: whose handles are the owner's, who is never recorded, the floor.

    Both lists may be given as values or as a table with a column ``ident``; they are joined
    either way, so neither has a limit.
    """

    own_handles: tuple[str, ...] | DataFrame
    never_ingest: tuple[str, ...] | DataFrame = ()
    zone: str = "UTC"
    min_turns: int = 2
    min_senders: int = 2
    min_chars: int = 20
    max_stamps: int = 200
    tranche_days: int = 30
    stale_days: int = 3
    claim_limit: int = 15
    #: Width of the time slices a conversation-day is cut into before any ordered work.
    slice_seconds: int = 300

    def __post_init__(self) -> None:
        own = self.own_handles
        if own.isEmpty() if isinstance(own, DataFrame) else not own:
            raise ValueError("own_handles is empty: the owner's own messages would be filed "
                             "as somebody else's, so the run is refused")


def listing(spark: SparkSession, handles: tuple[str, ...] | DataFrame) -> DataFrame:
    """A configured list as a table of distinct ``ident``."""
    if isinstance(handles, DataFrame):
        return handles.select("ident").filter("ident IS NOT NULL").distinct()
    values = F.array(*map(F.lit, dict.fromkeys(handles))).cast("array<string>")
    return spark.range(1).select(F.explode(values).alias("ident"))
