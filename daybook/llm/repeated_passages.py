"""Passages that stand in several places of the message texts, removed to the byte.

A suffix sort over a content-defined difference cover.  A cover must hold, for any two places
with equal text ahead, a shift at which both are sampled.  Residues do that for all pairs of
places but sample a fixed share of every byte; here the sample is the least k-gram hash of each
window, which does it for all pairs whose next ``WINDOW`` bytes are equal, with one sampled place
in about 85 bytes.  The steps are those of the algorithm: the sampled places are named by their
triples (what the windows hold before, at and after them), the names are sorted and neighbours
compared; where a name is not decided by its triple, the work recurses on shorter runs of windows,
named by what all of them hold, and at last on the remaining suffixes that lead to the sampled
place, one window each, again by sorting and comparing neighbours.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.texts import ragged

#: Bytes that must be repeated.
WINDOW = 200
#: Bytes of the k-gram that a sampled place is chosen by.
GRAM = 32
#: Windows of a shorter run: those whose distance to the sampled place falls into one block.
BLOCK = 16
#: Text bytes of one group, and names that one bucket is asked for, about.
GROUP_BYTES = 4_000_000
BUCKET_NAMES = 1_000_000
#: Places that are hashed at a time: few enough that the arrays stay in a core's cache.
STEP = 1 << 15
_PLACE = np.uint64(32)
#: How a name stands: what it stands for is met once, every window of it is repeated, or it must
#: be looked at one level down.
ONCE, ALL, SOME = 0, 1, 2
PLACES, RUNS, WINDOWS = 0, 1, 2

_ASK = "grp long, level int, bucket long, a binary, b binary, n binary"
_TOLD = "grp long, level int, bucket long, told binary"


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values *= np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    return values


#: Hash of each byte value.
with np.errstate(over="ignore"):
    _BYTES = _mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))


def _blocks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all blocks of ``GRAM`` and of 128 bytes, by doubling; entry i begins at i."""
    h, size, gram = _BYTES[data], 1, None
    while size < 128:
        if len(h) > size:
            h = h[:-size] * np.uint64(2 * size * 0x632BE5AB + 0x1B873593) + h[size:]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        else:
            h = h[:0]
        size *= 2
        gram = h if size == GRAM else gram
    return gram, h


class Group:
    """The sampled places of a group's texts and the names of all levels.

    A run is a stretch of neighbouring windows that choose the same place; windows never cross
    texts.  Level ``PLACES`` names a run by the k-gram at its place, level ``RUNS`` its blocks by
    the bytes that all windows of a block hold, level ``WINDOWS`` by the window itself.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.starts, of = ragged(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = max(0, len(data) - WINDOW + 1)
        self.long = np.empty(max(0, len(data) - 127), dtype=np.uint64)
        whole = np.ones(n, dtype=bool)
        for end in self.starts[1:].tolist():
            whole[max(0, end - WINDOW + 1):end] = False
        runs = [np.zeros((4, 0), dtype=np.int64)]
        with np.errstate(over="ignore"):
            for a in range(0, len(self.long), STEP):
                b = min(a + STEP, n)
                gram, long = _blocks(data[a:a + STEP + WINDOW - 1])
                self.long[a:a + STEP] = long[:STEP]
                if a < n:
                    runs.append(self._runs_of(gram, whole[a:b], a))
        first, last, self.at, gram = np.concatenate(runs, axis=1)
        # A run that goes on past a step is one.
        new = np.r_[True, (self.at[1:] != self.at[:-1]) | (first[1:] != last[:-1] + 1)][:len(first)]
        head = np.flatnonzero(new)
        self.first, self.last = first[head], last[np.r_[head[1:], len(first)][:len(head)] - 1]
        self.at, self.gram = self.at[head], gram[head].view(np.uint64)

    def _runs_of(self, gram: np.ndarray, whole: np.ndarray, a: int) -> np.ndarray:
        """First and last window, place and gram of the runs among the windows from ``a`` on."""
        chosen = self._chosen(gram, len(whole))
        edge = np.flatnonzero((chosen[1:] != chosen[:-1]) | (whole[1:] != whole[:-1])) + 1
        first, last = np.r_[0, edge], np.r_[edge, len(whole)] - 1
        mine = whole[first]
        first, last = first[mine], last[mine]
        at = chosen[first]
        return np.stack([a + first, a + last, a + at, gram[at].view(np.int64)])

    @staticmethod
    def _chosen(gram: np.ndarray, n: int) -> np.ndarray:
        """Place of the least (truncated) hash of each window, the last of equal ones."""
        wide = WINDOW - GRAM + 1
        low = np.uint64((1 << 32) - 1)
        key = ((gram >> _PLACE) << _PLACE) | (low - np.arange(len(gram), dtype=np.uint64))
        rows = np.concatenate([key, np.full(-len(key) % wide, ~np.uint64(0))]).reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[wide - 1:wide - 1 + n])
        return (low - (least & low)).astype(np.int64)

    def piece(self, start: np.ndarray, size: int) -> np.ndarray:
        """Hash of ``size`` bytes (128 to 256) from each start: two blocks that cover them."""
        return _mix(self.long[start] * np.uint64(3) + self.long[start + size - 128])

    def _hull(self, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of all that the windows ``first`` .. ``last`` hold, and where the place is."""
        where = ((last - first) << 20 | (at - first)).astype(np.uint64)
        return _mix(_mix(self.piece(first, WINDOW) * np.uint64(7) + self.piece(last, WINDOW))
                    + _mix(where))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return self.gram, self._hull(self.first, self.last, self.at)

    def runs(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first, last, name, triple) of the blocks of the given runs."""
        far, near = self.at[rows] - self.first[rows], self.at[rows] - self.last[rows]
        low = near // BLOCK
        starts, of = ragged(far // BLOCK - low + 1)
        block = low[of] + np.arange(len(of)) - starts[of]
        at = self.at[rows][of]
        first = np.maximum(at - BLOCK * block - BLOCK + 1, self.first[rows][of])
        last = np.minimum(at - BLOCK * block, self.last[rows][of])
        with np.errstate(over="ignore"):
            core = self.piece(at - BLOCK * block, WINDOW - BLOCK + 1)
            name = _mix(core + _mix(self.gram[rows][of] + block.astype(np.uint64)))
            return first, last, name, self._hull(first, last, at)

    @staticmethod
    def windows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of the given runs, and the run of each."""
        starts, of = ragged(last - first + 1)
        return first[of] + np.arange(len(of)) - starts[of], of


def _named(names: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct names ascending, the triple of each (0 if it has several), how often (2 at most),
    and the entry of each row."""
    order = np.lexsort((triples, names))
    n, t = names[order], triples[order]
    new = np.r_[True, n[1:] != n[:-1]][:len(n)]
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(n)][:len(head)] - 1
    of = np.empty(len(n), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    alone = np.where(t[head] == t[tail], np.maximum(t[head], np.uint64(1)), np.uint64(0))
    return n[head], alone, np.minimum(tail - head + 1, 2).astype(np.uint8), of


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (a, b) in order, how often each (2 at most), and the entry of each row."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][:len(x)]
    head = np.flatnonzero(new)
    of = np.empty(len(x), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return x[head], y[head], np.minimum(np.diff(np.r_[head, len(x)]), 2).astype(np.uint8), of


def _by_bucket(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending ``values`` by bucket, and where each bucket ends."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _asked(grp: int, level: int, buckets: int, a: np.ndarray, b: np.ndarray, n: np.ndarray,
           ) -> pa.Table:
    """One row per bucket that is asked for something."""
    order, ends = _by_bucket(a, buckets)
    cuts = [(k, order[i:j]) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True))
            if j > i]
    return pa.table({
        "grp": pa.array([grp] * len(cuts), pa.int64()),
        "level": pa.array([level] * len(cuts), pa.int32()),
        "bucket": pa.array([k for k, _ in cuts], pa.int64()),
        **{name: pa.array([v[c].tobytes() for _, c in cuts], pa.binary())
           for name, v in (("a", a), ("b", b), ("n", n))}})


def _answers(told: pa.Table, level: int, buckets: int, a: np.ndarray) -> np.ndarray:
    """The buckets' answers in the order of ``a``."""
    mine = sorted((k, t) for k, lev, t in zip(
        told.column("bucket").to_pylist(), told.column("level").to_pylist(),
        told.column("told").to_pylist(), strict=True) if lev == level)
    out = np.empty(len(a), dtype=np.uint8)
    out[_by_bucket(a, buckets)[0]] = np.frombuffer(b"".join(t for _, t in mine), dtype=np.uint8)
    return out


class Passages:
    """The work on one group of texts; every call sees the texts again and keeps nothing."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    @staticmethod
    def texts(group: pa.Table) -> list[bytes]:
        return [(t or "").encode("utf-8", "surrogatepass")
                for t in group.column("text").to_pylist()]

    def ask(self, level: int, group: pa.Table, told: pa.Table | None = None) -> pa.Table:
        """What a group asks at a level, given the answers of the levels above."""
        none = [np.zeros(0, np.uint64)] * 2
        if not group.num_rows:
            return _asked(0, level, self.buckets, *none, np.zeros(0, np.uint8))
        work = Group(self.texts(group))
        grp = group.column("grp")[0].as_py()
        if level == PLACES:
            return _asked(grp, level, self.buckets, *_named(*work.places())[:3])
        first, last, name, triple, _ = self._runs(work, told)
        if level == RUNS:
            return _asked(grp, level, self.buckets, *_named(name, triple)[:3])
        starts, of = work.windows(first, last)
        with np.errstate(over="ignore"):
            return _asked(grp, level, self.buckets,
                          *_sorted_pairs(name[of], work.piece(starts, WINDOW))[:3])

    def _runs(self, work: Group, told: pa.Table) -> tuple[np.ndarray, ...]:
        """(first, last, name, triple, repeated starts) by the answers at hand.

        The runs returned are those still open at the deepest level answered; the starts are the
        windows that are known to be repeated so far.
        """
        names, _, _, of = _named(*work.places())
        state = _answers(told, PLACES, self.buckets, names)[of]
        hits = [work.windows(work.first[state == ALL], work.last[state == ALL])[0]]
        first, last, name, triple = work.runs(np.flatnonzero(state == SOME))
        if RUNS in set(told.column("level").to_pylist()):
            names, _, _, of = _named(name, triple)
            state = _answers(told, RUNS, self.buckets, names)[of]
            hits.append(work.windows(first[state == ALL], last[state == ALL])[0])
            first, last, name, triple = (v[state == SOME] for v in (first, last, name, triple))
        return first, last, name, triple, np.concatenate(hits)

    def remove(self, group: pa.Table, told: pa.Table) -> pa.Table:
        """The result rows of a group, by all answers."""
        texts = self.texts(group)
        work = Group(texts)
        first, last, name, _, hits = self._runs(work, told)
        starts, of = work.windows(first, last)
        if len(starts):
            with np.errstate(over="ignore"):
                x, _, _, row = _sorted_pairs(name[of], work.piece(starts, WINDOW))
            again = _answers(told, WINDOWS, self.buckets, x)[row] == ALL
            hits = np.concatenate([hits, starts[again]])
        edge = np.zeros(work.starts[-1] + 1, dtype=np.int64)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        out = [_result(t, gone[a:b]) for t, a, b in zip(
            texts, work.starts[:-1], work.starts[1:], strict=True)]
        columns = list(zip(*out, strict=True))
        return pa.table({
            "rowid": group.column("rowid"),
            **{name: pa.array(c, pa.int64()) for name, c in zip(
                ("n_bytes", "n_removed", "n_spans"), columns, strict=False)},
            "kept_sha256": pa.array(columns[3], pa.string())})


def _result(text: bytes, gone: np.ndarray) -> tuple[int, int, int, str]:
    removed = int(gone.sum())
    if not removed:
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
    return len(text), removed, spans, hashlib.sha256(kept).hexdigest()


def answer(bucket: pa.Table) -> pa.Table:
    """Sort all that a bucket is asked for, compare neighbours, and answer in the order asked.

    A name is met once, or always with the same triple, or with several triples; a window is met
    once or again.
    """
    level = bucket.column("level")[0].as_py()
    a, b, n = ([np.frombuffer(v, dtype=t) for v in bucket.column(c).to_pylist()]
               for c, t in (("a", np.uint64), ("b", np.uint64), ("n", np.uint8)))
    cuts = np.cumsum([0, *map(len, a)])
    a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n).astype(np.int64)
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.r_[True, x[1:] != x[:-1]]
    if level == WINDOWS:
        new |= np.r_[True, y[1:] != y[:-1]]
    head = np.flatnonzero(new)
    times = np.add.reduceat(n[order], head)
    told = np.where(times < 2, ONCE, ALL)
    if level != WINDOWS:
        tail = np.r_[head[1:], len(x)] - 1
        told = np.where((times >= 2) & ((y[head] == 0) | (y[head] != y[tail])), SOME, told)
    out = np.empty(len(a), dtype=np.uint8)
    out[order] = told[np.cumsum(new) - 1]
    return pa.table({"grp": bucket.column("grp"), "level": bucket.column("level"),
                     "bucket": bucket.column("bucket"),
                     "told": pa.array([out[i:j].tobytes() for i, j in zip(
                         cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def remove_repeated_passages(messages: DataFrame) -> DataFrame:
    """What is left of every message body without its repeated passages.

    ``messages``: ``rowid, text`` (other columns are ignored).  A byte of a body's UTF-8 goes if
    some ``WINDOW`` bytes around it also start at any other place of any body, its own included;
    all is judged on the bodies as given.  Returns ``rowid, n_bytes, n_removed, n_spans,
    kept_sha256``.

    Bodies are dealt by hash into groups.  A group asks for each of its distinct names once, in
    buckets of the name, so a passage that stands everywhere is one entry per group.  All rounds
    of questions and the removal use one shuffle of the texts; nothing but hashes and answers
    moves besides.  Windows are compared by 128 bits of hash: their own 64 and those of their
    place and block.

    NULL and short bodies lose nothing; repeated rows are copies of each other; an empty table
    gives an empty table; bodies are read whole.
    """
    size = messages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))
    work = Passages(max(1, math.ceil(size / 85 / BUCKET_NAMES)))
    rows = messages.select(
        F.pmod(F.xxhash64("rowid", "text"), F.lit(groups)).cast("long").alias("grp"),
        F.col("rowid").cast("long"), "text")

    # Plain functions: Spark tells key-taking ones by their number of arguments.
    def ask_places(group: pa.Table) -> pa.Table:
        return work.ask(PLACES, group)

    def ask_runs(group: pa.Table, told: pa.Table) -> pa.Table:
        return work.ask(RUNS, group, told)

    def ask_windows(group: pa.Table, told: pa.Table) -> pa.Table:
        return work.ask(WINDOWS, group, told)

    def remove(group: pa.Table, told: pa.Table) -> pa.Table:
        return work.remove(group, told)

    def told(asked: DataFrame) -> DataFrame:
        return asked.groupBy("level", "bucket").applyInArrow(answer, _TOLD)

    def beside(answers: DataFrame):
        return rows.groupBy("grp").cogroup(answers.groupBy("grp"))

    answers = told(rows.groupBy("grp").applyInArrow(ask_places, _ASK))
    for ask in (ask_runs, ask_windows):
        answers = answers.union(told(beside(answers).applyInArrow(ask, _ASK)))
    return beside(answers).applyInArrow(
        remove, "rowid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
