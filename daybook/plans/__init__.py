"""Registered queries."""

from importlib import import_module

MODULES = ("q_messages", "q_people", "q_text", "q_ledger", "q_review", "q_reports", "q_stream")


def load_all() -> None:
    """Import every query module once; importing registers its queries."""
    for name in MODULES:
        import_module(f"daybook.plans.{name}")
