"""Daybook: turns large message logs into one dated line per person per day, on Spark."""

from daybook.config import Settings
from daybook.session import build_session, configure

__all__ = ["Settings", "build_session", "configure"]
