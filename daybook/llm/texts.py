"""What every job over message texts shares: words, batches of bounded size, hold-out folds."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.session import checkpoint_dir

#: Code points that one vectorised step works on at most; a longer text is a step of its own.
STEP_CHARS = 1_000_000


def crc_fold(ident: str | Column, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``: the fold a row belongs to."""
    col = F.col(ident) if isinstance(ident, str) else ident
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def steps(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) runs of ``texts`` of at most ``most`` code points, or one longer text."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_columns(schema: str, work: Callable[[list[str]], dict[str, Any]],
                 keep_null: bool = False) -> Callable[[Column | str], Column]:
    """A struct column computed from a text column, batch by batch.

    ``work`` gets a bounded list of whole texts (NULL as empty, or as None with ``keep_null``)
    and returns one sequence per field of ``schema``.  The column is marked as non-deterministic
    so that a filter on it and a projection of it share one evaluation.
    """
    def run(column: pd.Series) -> pd.DataFrame:
        texts = column.tolist()
        full = ["" if t is None else t for t in texts]
        parts = [pd.DataFrame(work(texts[a:b] if keep_null else full[a:b]))
                 for a, b in steps(full)]
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(work([]))

    return F.pandas_udf(run, schema).asNondeterministic()


def word_bytes(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: what ``bytes.split`` takes as white space."""
    return text.encode("utf-8", "surrogatepass").split()


def numbered(values: Iterable[Hashable]) -> tuple[np.ndarray, list]:
    """The number of each value in order of first sight, and the distinct values.

    A plain dictionary: array factorising takes strings that differ after a NUL for equal.
    """
    seen: dict = {}
    codes = np.array([seen.setdefault(v, len(seen)) for v in values], dtype=np.int64)
    return codes, list(seen)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row starts (one more than rows) and the row number of every element."""
    starts = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    return starts, np.repeat(np.arange(len(lengths)), lengths)


def per_row_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ragged rows, empty rows included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def shared_dir(df: DataFrame) -> str:
    """The folder that driver and executors share."""
    return checkpoint_dir(df.sparkSession)
