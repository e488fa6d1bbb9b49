"""Message texts packed into token sequences: vector best-fit."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daybook.llm.texts import steps
from daybook.llm.token_counts import PRE_TOKEN, byte_letters
from daybook.session import durable

#: Pieces that one task step packs together; more pieces are more groups.
GROUP_PIECES = 8_192
_PIECE = "rowid long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, pieces, and the sum of squared piece lengths.

    ``weights`` scale the three residual shares when bins are compared; ``rule`` is
    ``residual_norm`` (smallest weighted residual after placing) or ``dot_product`` (largest
    weighted product of the piece's demand and the bin's residual).
    """

    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "residual_norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.pieces, self.attention], dtype=np.float64)


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The vocabulary file as ranks, which are its ids, and its special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    byte = byte_letters()
    ranks = {bytes(byte[c] for c in token): number
             for token, number in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks,
                             special_tokens=special), special


@lru_cache(maxsize=2)
def _whole_encoder(path: str) -> Tokenizer:
    """The library's own encoder: slower, but without a limit on a run of blanks."""
    return Tokenizer.from_file(path)


def token_ids(text: str, path: str, end: int = 0) -> np.ndarray:
    """Ids of the whole text, special strings as their own ids, then ``end``.

    A text that the fast encoder refuses, such as one with a million blanks in a row, is encoded
    by the slower one, which gives the same ids.
    """
    encoding, special = _encoder(path)
    try:
        ids = encoding.encode_to_numpy(text, allowed_special=set(special), disallowed_special=())
    except ValueError:
        ids = np.array(_whole_encoder(path).encode(text, add_special_tokens=False).ids,
                       dtype=np.uint32)
    return np.append(ids, np.uint32(end)).astype("<u4")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, and a shorter one first if ``n`` is no multiple."""
    first = n % most
    pieces = [(0, first)] if first else []
    return pieces + [(s, most) for s in range(first, n, most)]


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; pieces should come longest first.

    Each bin keeps its residual of all three capacities.  A piece may go to any open bin that
    has room for it under every constraint; among those the rule picks.  Bins are looked up by
    residual tokens from the exact fit up, so only bins that can hold the piece are compared.
    """
    limits = capacity.limits()
    weights = np.array(capacity.weights)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], axis=1)
    if (demand > limits).any():
        raise ValueError("a piece alone is over the capacity of a sequence")
    residual = np.empty((len(lengths), 3))
    filled = np.zeros(len(lengths), dtype=np.int64)
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    used, open_bins = 0, np.zeros(0, dtype=np.int64)
    for i, need in enumerate(demand):
        fits = open_bins[(residual[open_bins] >= need).all(axis=1)]
        if len(fits):
            rest = residual[fits]
            if capacity.rule == "dot_product":
                score = -(weights * rest / limits * (need / limits)).sum(axis=1)
            else:
                score = (weights * ((rest - need) / limits) ** 2).sum(axis=1)
            b = fits[np.argmin(score)]
        else:
            b, used = used, used + 1
            residual[b] = limits
            open_bins = np.append(open_bins, b)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += int(need[0])
        residual[b] -= need
        if (residual[b] < 1).any():
            open_bins = open_bins[open_bins != b]
    return bins, offsets


def cut_messages(messages: DataFrame, vocabulary: str, capacity: Capacity = Capacity(),
                 end: int = 0) -> DataFrame:
    """``rowid, text`` -> one row per piece: ``rowid, piece, start, length, ids_crc32, copy``."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rowids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in steps(texts):
                rows = []
                for rowid, text in zip(rowids[a:b], texts[a:b], strict=True):
                    ids = token_ids(text, vocabulary, end)
                    rows += [(rowid, k, s, n, zlib.crc32(ids[s:s + n].tobytes()))
                             for k, (s, n) in enumerate(cut(len(ids), capacity.tokens))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                    names=["rowid", "piece", "start", "length", "ids_crc32"])
    return (messages.select(F.col("rowid").cast("long"), "text").mapInArrow(pieces, _PIECE)
            .withColumn("copy", F.monotonically_increasing_id()))


def pack_messages(messages: DataFrame, vocabulary: str, capacity: Capacity = Capacity(),
                  end: int = 0) -> DataFrame:
    """All message bodies as pieces placed in sequences of at most ``capacity``.

    ``messages``: ``rowid, text`` (other columns are ignored).  A body's ids are those of the
    vocabulary file, then ``end``; a body over the token capacity is cut into full pieces, the
    first one shorter where the length is no multiple.  Returns ``rowid, piece, start, length,
    ids_crc32, sequence_id, offset``, offsets being gapless from 0 in each sequence.

    The texts are read once and map-only; only piece rows are shuffled.  A piece that fills a
    sequence is one.  The others are dealt by hash into groups of about ``GROUP_PIECES``, each
    with the lengths of the whole, and packed longest first by ``best_fit``.  Sequences left
    under nine tenths full are opened again, and their pieces are dealt and packed once more.

    NULL and empty bodies are one piece that holds only ``end``; repeated rows and rows without an id
    are packed each; a body of any length is cut, never left out.  Pieces of one length are taken in
    the order of their copies, sequences that fit equally well in the order they were opened.  An
    empty table gives an empty table.
    """
    pieces = durable(cut_messages(messages, vocabulary, capacity, end))
    whole = pieces.filter(F.col("length") >= capacity.tokens).select(
        "rowid", "piece", "start", "length", "ids_crc32",
        (-1 - F.col("copy")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = pieces.filter(F.col("length") < capacity.tokens)
    first = durable(_pack(parts, capacity, 0))
    filled = first.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    poor = filled.filter(F.col("filled") < 0.9 * capacity.tokens).select("sequence_id")
    again = _pack(first.join(poor, "sequence_id", "left_semi").select(
        "rowid", "piece", "start", "length", "ids_crc32", "copy"), capacity, 1)
    kept = first.join(poor, "sequence_id", "left_anti")
    columns = whole.columns
    return whole.union(kept.select(columns)).union(again.select(columns))


def _pack(parts: DataFrame, capacity: Capacity, pass_no: int) -> DataFrame:
    """Deal pieces into groups and pack each; sequence ids carry the pass and the group."""
    groups = max(1, -(-parts.count() // GROUP_PIECES))

    def pack(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["length", "copy"], ascending=[False, True],
                                  ignore_index=True)
        bins, offsets = best_fit(piece["length"].to_numpy(), capacity)
        base = (pass_no << 56) | (int(piece["deal"].iloc[0]) << 24)
        return piece.drop(columns="deal").assign(sequence_id=base + bins, offset=offsets)

    dealt = parts.withColumn("deal", F.pmod(F.xxhash64("copy", F.lit(pass_no)), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(
        pack, _PIECE + ", copy long, sequence_id long, offset long")
