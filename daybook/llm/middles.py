"""Fill-in-the-middle form of message texts: lines cut into prefix, middle and suffix, reordered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks in front of the three pieces.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: UTF-8 bytes that one Arrow step works on at most; a longer text is a step of its own.
STEP_BYTES = 8_000_000


def _draws(ident: str, seed: int) -> list[Column]:
    """Four unsigned numbers below 2 ** 32 that only the id and the seed decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))),
                    256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
            for i in range(4)]


def _bounded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs whose texts hold at most ``STEP_BYTES`` bytes together."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, ends = 0, np.cumsum(size, dtype=np.int64)
        while start < len(size):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + STEP_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _strings(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def _glued(*parts: pa.Array | str) -> pa.Array:
    """Texts and marks joined row by row."""
    wide = [pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in parts]
    return pc.binary_join_element_wise(*wide, pa.scalar("", pa.large_string()))


def _modulo(value: pa.Array, by: pa.Array | int) -> pa.Array:
    return pc.subtract(value, pc.multiply(pc.divide(value, by), by))


def _units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Lines with their ends, the row and the place in the row of each, and lines per row."""
    pieces = pc.split_pattern(texts, "\n")
    row, piece = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    held = pc.list_value_length(pieces).cast(pa.int64())
    starts = pa.array(np.concatenate([[0], np.cumsum(held.to_numpy())[:-1]]), pa.int64())
    place = pc.subtract(pa.array(np.arange(len(piece)), pa.int64()), pc.take(starts, row))
    last = pc.equal(place, pc.subtract(pc.take(held, row), 1))
    line = pc.if_else(last, piece, _glued(piece, "\n"))
    real = pc.greater(pc.binary_length(line), 0)
    ended = pc.ends_with(texts, "\n")
    open_end = pc.or_(ended, pc.equal(pc.binary_length(texts), 0))
    return (line.filter(real), row.filter(real), place.filter(real),
            pc.subtract(held, open_end.cast(pa.int64())))


def _joined(lines: pa.Array, chosen: pa.Array, lengths: pa.Array) -> pa.Array:
    """The chosen lines as one list per row, each list as one text."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths.to_numpy())]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, lines.filter(chosen)),
                          pa.scalar("", pa.large_string()))


def transformed(batch: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    """One step over ``(rowid, text, h1, h2, h3, h4)``."""
    texts = _strings(batch.column(1))
    h1, h2, h3, h4 = (batch.column(i) for i in range(2, 6))
    lines, row, place, n = _units(texts)
    cut, other = (_modulo(h, pc.add(n, 1)) for h in (h1, h2))
    a, b = pc.min_element_wise(cut, other), pc.max_element_wise(cut, other)
    before, behind = pc.less(place, pc.take(a, row)), pc.greater_equal(place, pc.take(b, row))
    prefix = _joined(lines, before, a)
    middle = _joined(lines, pc.invert(pc.or_(before, behind)), pc.subtract(b, a))
    suffix = _joined(lines, behind, pc.subtract(n, b))
    plain = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.greater_equal(_modulo(h3, 100), rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    swapped = pc.less(_modulo(h4, 100), spm)
    form = pc.if_else(plain, "plain", pc.if_else(swapped, "spm", "psm"))
    straight = _glued(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    turned = _glued(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    output = pc.if_else(plain, texts, pc.if_else(swapped, turned, straight))
    none = pa.scalar(None, pa.int64())
    sizes = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return pa.record_batch([batch.column(0), n, form.cast(pa.string()), *sizes,
                            output.cast(pa.string())],
                           ["rowid", "n", "form", "prefix_chars", "middle_chars", "output"])


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The original texts from outputs and forms alone."""
    def halves(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
        parts = pc.split_pattern(texts, mark, max_splits=1)
        return pc.list_element(parts, 0), pc.list_element(parts, 1)

    output, places = _strings(output), np.arange(len(form))
    texts, order = [], []
    for kind in ("plain", "psm", "spm"):
        mine = pc.equal(form, kind)
        found = output.filter(mine)
        if kind != "plain":
            first, rest = halves(pc.utf8_slice_codeunits(found, len(PREFIX)),
                                 SUFFIX if kind == "psm" else PREFIX)
            second, middle = halves(rest, MIDDLE)
            prefix, suffix = (first, second) if kind == "psm" else (second, first)
            found = _glued(prefix, middle, suffix)
        texts.append(found)
        order.append(places[mine.to_numpy(zero_copy_only=False)])
    return pa.concat_arrays(texts).take(pa.array(np.argsort(np.concatenate(order))))


def _in_arrow(df: DataFrame, column: int, work: Callable[[pa.RecordBatch], pa.RecordBatch],
              schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, column):
            yield work(batch)

    return df.mapInArrow(run, schema)


def fill_in_middle(messages: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Message bodies as training samples: ``rowid, n, form, prefix_chars, middle_chars, output``.

    ``messages`` has ``rowid, text``; other columns are ignored, whatever their names.  A body is
    cut into its ``n`` lines, ends included.  Two draws from ``seed`` and the row id choose where
    the prefix and where the middle ends; a third leaves a body as it is (form ``plain``) unless it
    falls below ``rate`` percent, a fourth turns prefix and suffix round (``spm``, else ``psm``)
    below ``spm`` percent.  Lengths are code points.  Map-only, in Arrow steps of bounded bytes.

    A NULL or empty body, and one that holds a mark, is ``plain`` with NULL lengths; NULL comes out
    empty.  Equal draws give an empty middle.  Repeated rows of an id are cut alike if their bodies
    are alike; a NULL id draws as an empty one.  A body of any length is taken whole, in a step of
    its own.  An empty table gives an empty table.
    """
    kind = messages.schema["rowid"].dataType
    schema = T.StructType([T.StructField("rowid", kind), T.StructField("n", T.LongType()),
                           T.StructField("form", T.StringType()),
                           T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()),
                           T.StructField("output", T.StringType())])
    rows = messages.select("rowid", "text", *_draws("rowid", seed))
    return _in_arrow(rows, 1, lambda batch: transformed(batch, rate, spm), schema)


def restore_messages(samples: DataFrame) -> DataFrame:
    """``samples`` of :func:`fill_in_middle` with one more column, the original text ``restored``.

    Only ``output`` and ``form`` are read.  A NULL body comes back empty; NULLs, ties, repeated
    rows and empty tables need no further rule, every row stands for itself.
    """
    named = samples.select([c for c in samples.columns if c != "restored"])
    place = {name: named.columns.index(name) for name in ("output", "form")}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = rebuilt(batch.column(place["output"]), batch.column(place["form"]))
        return pa.record_batch([*batch.columns, text.cast(pa.string())],
                               [*batch.schema.names, "restored"])

    schema = T.StructType([*named.schema.fields, T.StructField("restored", T.StringType())])
    return _in_arrow(named, place["output"], work, schema)
