"""Named queries, each with the independent SQL it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from daybook.plans.adapters import ADAPTERS, adapter_sql
from daybook.session import configure

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    oracle: str | None


ENTRIES: dict[str, Entry] = {}
#: Shared building blocks of the oracles: name -> DuckDB SELECT.
BLOCKS: dict[str, str] = {}

_SOURCE = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)")


def block(name: str, sql: str) -> None:
    BLOCKS[name] = sql


def with_blocks(sql: str) -> str:
    """``sql`` with every block and adapter it reads put in front as a WITH clause."""
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in dict.fromkeys(_SOURCE.findall(text)):
            if name in done or (name not in BLOCKS and name not in ADAPTERS):
                continue
            body = BLOCKS[name] if name in BLOCKS else adapter_sql(name)[1]
            visit(body)
            done.setdefault(name, body)

    visit(sql)
    if not done:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in done.items()) + "\n" + sql


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn`` under ``name``, with its oracle when a fair SQL twin exists."""
    def register(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, base: str) -> DataFrame:
            configure(spark)
            return fn(spark, base)

        ENTRIES[name] = Entry(run, with_blocks(oracle) if oracle else None)
        return fn
    return register
