"""Benchmark passages inside message texts: size-partitioned MinHash containment search."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.texts import numbered, ragged, steps, text_columns
from daybook.operators.ranking import number_rows

#: Items searched for in one pass over the messages; further items are further passes.
ITEMS_PER_PASS = 20_000

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HIT = "rowid long, item_id long, shared long, item_shingles long, containment double"


def plain_words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased: punctuation and layout do not hide a passage."""
    return _WORD.findall(text.lower())


def _word_hashes(words: list[str]) -> np.ndarray:
    code, names = numbered(words)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w.encode(), 0) for w in names], dtype=np.uint64)[code]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words, from the words' own hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ hashes[k:k + n]) * _MIX
            out ^= out >> np.uint64(29)
    return out


@dataclass
class ItemIndex:
    """The items of one pass: a MinHash table per shingle length and their exact shingles.

    Items lie in size classes (powers of two of their distinct shingles).  With a containment of
    at least ``t``, at most (1 - t) * n of n shingles are missing, so of the floor((1 - t) * n) + 1
    smallest shingle hashes at least one is in the message: that many are kept, the number being
    set by the largest size of the class.  The search thus loses no item.
    """

    shingle: int
    least: float
    shingles: dict[int, set[tuple[str, ...]]] = field(default_factory=dict)
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], shingle: int, least: float) -> ItemIndex:
        index = cls(shingle, least)
        kept: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, text in items:
            words = plain_words(text or "")
            if not words:
                continue
            size = min(shingle, len(words))
            hashes = np.unique(window_hashes(_word_hashes(words), size))
            index.shingles[number] = {tuple(words[i:i + size])
                                      for i in range(len(words) - size + 1)}
            top = 1 << max(0, math.ceil(math.log2(len(hashes))))
            sketch = min(len(hashes), math.floor((1 - least) * top + 1e-9) + 1)
            kept[size] += [(int(h), number) for h in hashes[:sketch]]
        for size, pairs in kept.items():
            pairs.sort()
            hashes, first = np.unique(np.array([h for h, _ in pairs], dtype=np.uint64),
                                      return_index=True)
            index.tables[size] = (hashes, np.r_[first, len(pairs)],
                                  np.array([n for _, n in pairs], dtype=np.int64))
        return index

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item number, shared shingles, item's shingles) of every found item."""
        words = [plain_words(t) for t in texts]
        starts, row = ragged(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        if not len(row):
            return
        hashes = _word_hashes([w for ws in words for w in ws])
        candidates: set[tuple[int, int, int]] = set()
        for size, (known, first, number) in self.tables.items():
            windows = window_hashes(hashes, size)
            slot = np.minimum(np.searchsorted(known, windows), len(known) - 1)
            hit = np.flatnonzero(known[slot] == windows)
            hit = hit[row[hit] == row[hit + size - 1]]
            for at, s in set(zip(row[hit].tolist(), slot[hit].tolist(), strict=True)):
                candidates |= {(at, n, size) for n in number[first[s]:first[s + 1]].tolist()}
        held: dict[tuple[int, int], set[tuple[str, ...]]] = {}
        for at, item, size in sorted(candidates):
            if (at, size) not in held:
                held.clear()
                ws = words[at]
                held[at, size] = set(zip(*(ws[k:] for k in range(size))))
            of_item = self.shingles[item]
            shared = len(of_item & held[at, size])
            if shared >= self.least * len(of_item) - 1e-9:
                yield at, item, shared, len(of_item)


def _passes(items: DataFrame, item: str) -> Iterator[list[tuple[int, int, str | None]]]:
    """Blocks of at most ``ITEMS_PER_PASS`` items as (number, id, text)."""
    rows = items.select(F.col(item).cast("long").alias("item"), "text").distinct()
    if rows.limit(ITEMS_PER_PASS + 1).count() <= ITEMS_PER_PASS:
        blocks = [rows.collect()]
    else:
        placed = number_rows(rows, [F.col("item"), F.col("text")], "no")
        count = placed.agg(F.max("no")).first()[0]
        blocks = (placed.filter(F.col("no").between(a + 1, a + ITEMS_PER_PASS))
                  .select("item", "text").collect() for a in range(0, count, ITEMS_PER_PASS))
    for block in blocks:
        yield [(i, *r) for i, r in enumerate(block)]


def free_of_items(messages: DataFrame, items: DataFrame, item: str = "item_id",
                  shingle: int = 5, least: float = 0.8, text: str = "text") -> DataFrame:
    """``messages`` with all its columns, without the rows whose body contains an item.

    Containment as in ``contained_items``; decided row by row where the text is read, so nothing
    is joined or shuffled and rows without an id, and repeated ones, are judged like any other.  A
    NULL or blank body contains nothing and stays, long bodies are read whole, without items all rows
    stay, and an empty table gives an empty table.
    """
    for block in _passes(items, item):
        index = messages.sparkSession.sparkContext.broadcast(
            ItemIndex.of([(n, body) for n, _, body in block], shingle, least))

        def work(texts: list[str], index=index) -> dict:
            hit = {at for at, *_ in index.value.search(texts)}
            return {"found": [i in hit for i in range(len(texts))]}
        messages = messages.filter(~text_columns("found boolean", work)(text)["found"])
    return messages


def contained_items(messages: DataFrame, items: DataFrame, item: str = "item_id",
                    shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Which items' word shingles are contained in which message bodies.

    ``messages``: ``rowid, text``; ``items``: the column named by ``item`` and ``text`` (other
    columns are ignored).  A row ``rowid, item_id, shared, item_shingles, containment`` for each
    body that holds at least ``least`` of an item's distinct ``shingle``-word shingles; an item
    of fewer words is one shingle.  Words are lower-cased runs of letters and digits.

    The items of a pass are at most ``ITEMS_PER_PASS`` and go to the tasks as one read-only
    index; a larger table takes further passes, so no item is left out and what is sent stays
    bounded.  Messages are read map-only in each pass.  Candidates come from the MinHash tables,
    then the exact shingle sets decide.

    A NULL or blank body holds nothing, a NULL or blank item is found nowhere; equal items under
    several ids are reported for each, so ties keep all; repeated messages, and messages without an
    id, give rows of their own; bodies of any length are read whole.  No rows on either side give none.
    """
    spark = messages.sparkSession
    out = spark.createDataFrame([], _HIT)
    for block in _passes(items, item):
        ids = [r[1] for r in block]
        index = spark.sparkContext.broadcast(
            ItemIndex.of([(n, text) for n, _, text in block], shingle, least))

        def find(batches: Iterator[pa.RecordBatch], ids=ids, index=index,
                 ) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rowids = batch.column(0).to_pylist()
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for a, b in steps(texts):
                    hits = [(rowids[a + at], ids[n], s, total, s / total)
                            for at, n, s, total in index.value.search(texts[a:b])]
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(
                        hits, columns=["rowid", "item_id", "shared", "item_shingles",
                                       "containment"]).astype(
                        {"rowid": "Int64", "item_id": "Int64", "shared": "int64",
                         "item_shingles": "int64", "containment": "float64"}),
                        preserve_index=False)
        out = out.union(messages.select(F.col("rowid").cast("long"), "text")
                        .mapInArrow(find, _HIT))
    return out
