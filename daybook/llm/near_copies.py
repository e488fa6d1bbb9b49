"""Near copies among message texts: SimHash fingerprints in a Gray-order hierarchical index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.components import components
from daybook.llm.texts import text_columns, word_bytes
from daybook.session import durable

#: Fingerprints in a leaf node that one task step searches; larger nodes are cut deeper.
LEAF = 8_192
#: Queries that one task step searches in a leaf; more are dealt to further copies of the leaf.
QUERIES = 1 << 16
#: Bits by which an oversized node is cut deeper.
CUT_BITS = 4
#: Consecutive fingerprints in Gray order under one inner node of a leaf.
FAN_OUT = 16


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """64 majority bits over the XXH64 (seed 42) of all word shingles, repeats included."""
    words = word_bytes(text)
    if not words:
        return 0
    joined = b" ".join(words).lower()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(words_per_shingle, len(words))
    begin = [0, *(ends[:len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(begin, ends[k - 1:].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(words_per_shingle: int = 3):
    """text -> struct(fp): the fingerprint as a signed long; NULL and blank texts give zero."""
    def work(texts: list[str]) -> dict:
        values = np.array([fingerprint(t, words_per_shingle) for t in texts], dtype=np.uint64)
        return {"fp": values.view(np.int64)}
    return text_columns("fp long", work)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in Gray code order."""
    for shift in (1, 2, 4, 8, 16, 32):
        values = values ^ (values >> np.uint64(shift))
    return values


def patterns(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, bits) that all members of each row of ``groups`` share."""
    both, any_ = np.bitwise_and.reduce(groups, axis=1), np.bitwise_or.reduce(groups, axis=1)
    return ~(both ^ any_), both


def _folded(values: np.ndarray) -> np.ndarray:
    """Values in rows of ``FAN_OUT``, the last row filled up with its last value."""
    fill = -len(values) % FAN_OUT
    return np.concatenate([values, np.repeat(values[-1:], fill)]).reshape(-1, FAN_OUT)


def search_leaf(members: np.ndarray, queries: np.ndarray, radius: int,
                ) -> tuple[np.ndarray, np.ndarray]:
    """All (query, member) index pairs at most ``radius`` bits apart.

    The members lie in Gray order.  Every ``FAN_OUT`` consecutive ones are a node that holds the
    bits they share, and so on upwards.  A query walks down with the differences it has met on
    shared bits; a node whose count passes the radius falls with all that is below it.
    """
    order = np.argsort(gray_rank(members), kind="stable")
    levels = [members[order]]
    nodes: list[tuple[np.ndarray, np.ndarray]] = []
    groups = _folded(levels[0])
    while True:
        nodes.append(patterns(groups))
        if len(groups) == 1:
            break
        low, high = _folded(np.bitwise_and.reduce(groups, axis=1)), _folded(
            np.bitwise_or.reduce(groups, axis=1))
        # A parent shares what all its children share: AND of ANDs against OR of ORs.
        groups = np.concatenate([low, high], axis=1)
    q = np.arange(len(queries))
    node = np.zeros(len(queries), dtype=np.int64)
    for mask, bits in reversed(nodes):
        alive = node < len(mask)
        q, node = q[alive], node[alive]
        met = np.bitwise_count((queries[q] ^ bits[node]) & mask[node])
        q, node = q[met <= radius], node[met <= radius]
        node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
        q = np.repeat(q, FAN_OUT)
    alive = node < len(members)
    q, node = q[alive], node[alive]
    near = np.bitwise_count(queries[q] ^ levels[0][node]) <= radius
    return q[near], order[node[near]]


def _prefix(col: Column | str, depth: int) -> Column:
    """The first ``depth`` bits: Gray-order neighbours share them, so they name an upper node."""
    return F.shiftrightunsigned(col, 64 - depth) if depth else F.lit(0).cast("long")


def _flips(low: int, high: int, most: int) -> list[tuple[int, int]]:
    """(bits to flip among places ``low`` .. ``high`` from the top, how many) up to ``most``."""
    places = [1 << (63 - i) for i in range(low, high)]
    out = [(0, 0)]
    for n in range(most):
        out += [(m | p, n + 1) for m, c in out if c == n
                for p in places if p > m]  # each set once, ordered by place
    return [(m - (1 << 64) if m >= 1 << 63 else m, c) for m, c in dict.fromkeys(out)]


def _spread(front: DataFrame, low: int, high: int, radius: int) -> DataFrame:
    """Walk every query of ``front(q, at, met)`` down to the nodes at depth ``high``.

    ``at`` is the query with the bits flipped that lead to the node; ``met`` counts them.
    """
    table = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).alias("c"))
                      for m, c in _flips(low, high, radius)])
    return (front.withColumn("s", F.explode(F.filter(
        table, lambda s: s["c"] + F.col("met") <= radius)))
        .select("q", F.col("at").bitwiseXOR(F.col("s.m")).alias("at"),
                (F.col("met") + F.col("s.c")).alias("met")))


def linked_fingerprints(fps: DataFrame, radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """``fps(fp)`` distinct -> ``(a, b)``, ``a < b``: all pairs at most ``radius`` bits apart.

    The index is one hierarchy in Gray order.  Its upper nodes are bit prefixes and live in
    Spark: a query is sent to every existing node whose prefix differs in at most ``radius``
    places and carries the differences met so far; a node with more than ``leaf`` members is cut
    ``CUT_BITS`` deeper, again and again, and only the queries that reach it follow.  Leaf nodes
    are searched inside a task by their shared bit patterns (``search_leaf``).  The first depth
    follows from the number of fingerprints, so nodes stay small as the table grows, and a leaf
    that very many queries reach is copied, each copy with a bounded share of them.
    """
    total = fps.count()
    depth = min(63, max(0, math.ceil(math.log2(max(total, 1) / leaf))))
    front = fps.select(F.col("fp").alias("q"), F.col("fp").alias("at"), F.lit(0).alias("met"))
    low, open_members, found = 0, fps, []
    while True:
        # A pair is looked for from one side: the query goes to its own node and to later ones.
        front = (_spread(front, low, depth, radius).withColumn("node", _prefix("at", depth))
                 .filter(F.col("node") >= _prefix("q", depth)))
        members = open_members.withColumn("node", _prefix("fp", depth))
        nodes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        done = depth >= 64
        small = nodes if done else nodes.filter(F.col("n") <= leaf)
        found.append(_search(front, members, small, radius))
        if done or not nodes.filter(F.col("n") > leaf).limit(1).count():
            break
        large = nodes.filter(F.col("n") > leaf).select("node")
        front = durable(front.join(large, "node", "left_semi").select("q", "at", "met"))
        open_members = durable(members.join(large, "node", "left_semi").select("fp"))
        low, depth = depth, min(64, depth + CUT_BITS)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _search(front: DataFrame, members: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """Search every leaf of ``nodes``: copies of its members meet shares of its queries."""
    asked = front.groupBy("node").agg(F.count(F.lit(1)).alias("asked"))
    copies = nodes.join(asked, "node").select(
        "node", F.ceil(F.col("asked") / QUERIES).cast("int").alias("copies"))
    asks = front.join(copies, "node").select(
        "node", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int").alias("copy"), "q")
    held = members.join(copies, "node").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "fp")

    def search(queries: pa.Table, leaf: pa.Table) -> pa.Table:
        q = queries.column("q").to_numpy().view(np.uint64)
        m = leaf.column("fp").to_numpy().view(np.uint64)
        if not len(q) or not len(m):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = search_leaf(m, q, radius)
        a, b = q[i].view(np.int64), m[j].view(np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], axis=1)[low < high], axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    key = ["node", "copy"]
    return asks.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(search, "a long, b long")


def near_copies(messages: DataFrame, radius: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """Fingerprint and group of every message body: ``rowid, fingerprint, component_id``.

    ``messages``: ``rowid, text`` (other columns are ignored).  Two bodies are linked when their
    fingerprints differ in ``radius`` bits or fewer; ``component_id`` is the smallest rowid that
    can be reached over links, the row's own included.  Texts never leave the first map step.

    NULL and blank bodies have fingerprint zero and are linked like any other; equal texts and
    repeated rows share a fingerprint, whose links are searched once; a NULL rowid never names a
    group unless the group has no other; an empty table gives an empty table.
    """
    rows = durable(messages.select("rowid", fingerprint_column(words_per_shingle)("text")
                                   .alias("f")).select("rowid", F.col("f.fp").alias("fp")))
    fps = durable(rows.groupBy("fp").agg(F.min("rowid").alias("first")))
    linked = components(linked_fingerprints(fps.select("fp"), radius))
    of_fp = fps.join(linked, fps["fp"] == linked["node"], "left").select(
        fps["fp"], "first", F.coalesce("component", fps["fp"]).alias("component"))
    named = of_fp.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = of_fp.join(named, "component").select("fp", "component_id")
    return rows.join(groups, "fp").select(
        "rowid", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
