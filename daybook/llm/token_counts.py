"""Token counts of message texts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.texts import numbered, per_row_sum, ragged, text_columns

# --- fixed values: the split before the merges, as the vocabulary's library reads it ------
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
             r"| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# --- end of fixed values --------------------------------------------------------------------

#: A blank beside a space or at an end, or the character that ``units`` splits on.
UNEVEN_BLANKS = re.compile(r"\s | \s|\A\s|\s\Z|\0")


@dataclass(frozen=True)
class MergeTable:
    """A byte-level vocabulary as arrays: symbol of each byte, pairs in code order."""

    byte_symbol: np.ndarray
    pairs: np.ndarray      # left symbol * width + right symbol, ascending
    rank: np.ndarray       # rank of each pair
    made: np.ndarray       # symbol that each pair becomes
    width: int
    specials: tuple[str, ...]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def load_merges(path: str) -> MergeTable:
    """Read a byte-level vocabulary file; once per process."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    symbol = np.zeros(256, dtype=np.int64)
    for letter, byte in byte_letters().items():
        symbol[byte] = vocab[letter]
    width = max(vocab.values()) + 1
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    code = np.array([vocab[a] * width + vocab[b] for a, b in merges], dtype=np.int64)
    made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
    order = np.argsort(code, kind="stable")
    return MergeTable(symbol, code[order], order.astype(np.int64), made[order], width,
                      tuple(t["content"] for t in spec.get("added_tokens", ())))


def merge_counts(pre_tokens: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols left of each pre-token once no pair of the table is left in it.

    All pre-tokens lie in one flat array.  A round looks up every neighbouring pair, takes each
    sequence's lowest rank, and joins all places of that pair at once; in a run of overlapping
    places (``aaa``) every second one is taken, from the left.  A pair that a join makes always
    ranks behind the join itself, so taking all places at once equals taking them in turn.
    Sequences without a pair left leave the array with their count.
    """
    none = np.int64(len(table.pairs))
    lengths = np.fromiter(map(len, pre_tokens), dtype=np.int64, count=len(pre_tokens))
    counts = lengths.copy()
    flat = table.byte_symbol[np.frombuffer(b"".join(pre_tokens), dtype=np.uint8)]
    _, row = ragged(lengths)
    rank, made = np.full(len(flat), none), np.zeros(len(flat), dtype=np.int64)

    def look_up(at: np.ndarray) -> None:
        """Set rank and outcome of the pairs that begin at ``at``."""
        rank[at] = none
        at = at[at + 1 < len(flat)]
        code = flat[at] * table.width + flat[at + 1]
        slot = np.minimum(np.searchsorted(table.pairs, code), len(table.pairs) - 1)
        known = (table.pairs[slot] == code) & (row[at] == row[at + 1])
        rank[at], made[at] = np.where(known, table.rank[slot], none), table.made[slot]

    look_up(np.arange(len(flat)))
    while len(flat):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sizes = np.diff(np.r_[first, len(flat)])
        lowest = np.minimum.reduceat(rank, first)
        where = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank < none))
        # In a run of overlapping places, those at an even distance from the run's start.
        head = np.r_[True, np.diff(where) > 1][:len(where)]
        start = np.maximum.accumulate(np.where(head, where, 0))
        where = where[(where - start) % 2 == 0]
        flat[where] = made[where]
        np.subtract.at(counts, row[where], 1)
        keep = np.repeat(lowest < none, sizes)
        keep[where + 1] = False
        place = np.cumsum(keep) - 1
        where = place[where]
        flat, row, rank, made = flat[keep], row[keep], rank[keep], made[keep]
        look_up(np.r_[where, np.maximum(where - 1, 0)])
    return counts


def split_special(text: str, specials: tuple[str, ...]) -> tuple[list[str], int]:
    """The stretches between special strings, and how many special strings there are."""
    parts, found = [text], 0
    for special in specials:
        if special in text:
            cut = [p.split(special) for p in parts]
            found += sum(len(c) - 1 for c in cut)
            parts = list(chain.from_iterable(cut))
    return parts, found


def units(text: str, find) -> list[str]:
    """Pieces whose pre-tokens do not depend on what stands around them.

    Where every space stands alone between two non-blank characters, each space-led piece splits
    into pre-tokens by itself, so equal pieces are split once per batch.  Any other text is
    split as a whole.
    """
    if UNEVEN_BLANKS.search(text):
        return find(text)
    return text.replace(" ", "\0 ").split("\0") if text else []


def count_tokens(texts: list[str], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, tokens) of each text."""
    find = regex.compile(PRE_TOKEN).findall
    pieces: list[str] = []
    per_text = np.zeros(len(texts), dtype=np.int64)
    tokens = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        parts, found = split_special(text, table.specials)
        tokens[i] = found
        before = len(pieces)
        for part in parts:
            pieces.extend(units(part, find))
        per_text[i] = len(pieces) - before
    n_bytes = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], dtype=np.int64)
    if not pieces:
        return n_bytes, tokens
    code, distinct = numbered(pieces)
    split = [find(p) for p in distinct]
    unit_starts, _ = ragged(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))
    pre, names = numbered(chain.from_iterable(split))
    each = merge_counts([w.encode() for w in names], table)
    of_unit = per_row_sum(each[pre], unit_starts)
    starts, _ = ragged(per_text)
    return n_bytes, tokens + per_row_sum(of_unit[code], starts)


def token_columns(vocabulary: str, limit: int = 512):
    """text -> struct(n_bytes, n_tokens, over_limit); NULL counts as empty."""
    def work(texts: list[str]) -> dict:
        n_bytes, n_tokens = count_tokens(texts, load_merges(vocabulary))
        return {"n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > limit}
    return text_columns("n_bytes long, n_tokens long, over_limit boolean", work)


def count_message_tokens(messages: DataFrame, vocabulary: str, limit: int = 512,
                         text: str | Column = "text") -> DataFrame:
    """Tokens of every message body: ``rowid, n_bytes, n_tokens, over_limit``.

    ``messages`` is a message store or scan (``rowid, text``, other columns are ignored).  The
    job is map-only: a batch's distinct pre-tokens are merged together, nothing is shuffled and
    nothing is kept between batches.  ``vocabulary`` is the path of a byte-level vocabulary file
    that every executor can open.

    NULL and empty bodies count 0 bytes and 0 tokens; repeated rows give repeated rows; an empty
    table gives an empty table; very long bodies are counted whole, as a step of their own.
    """
    counted = messages.select(F.col("rowid"), token_columns(vocabulary, limit)(text).alias("c"))
    return counted.select("rowid", "c.n_bytes", "c.n_tokens", "c.over_limit")
