"""Log probabilities of message texts under a probabilistic suffix tree of their bytes.

The symbols are the bytes of normalised UTF-8, so every character of every script has its own
sequence of symbols and none shares one.  Contexts of up to ``DEPTH`` symbols are learned wherever
they occur ``SUPPORT`` times, however large the corpus is.  No tree is built in one place: a
context's suffix chain shares its last ``FAMILY`` symbols, by which windows are dealt; a family
holds all that its contexts' distributions and the divergence test ask for, but for the symbol
pairs, a table bounded by the symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.texts import per_row_sum, ragged, steps

#: Longest context in symbols, and bits per symbol in a packed context.
DEPTH = 5
BITS = 8
START, END, SPACE, OTHER = range(4)
#: Bytes with a symbol of their own: all that normalised UTF-8 can hold but the space.
ALPHABET = np.array([b for b in range(256) if not (
    9 <= b <= 13 or b == 32 or 65 <= b <= 90 or b in (0xC0, 0xC1) or b > 0xF4)], dtype=np.uint32)
WIDTH = len(ALPHABET) + 4
#: Two bytes that UTF-8 never holds stand for the start and the end of a text.
_START_BYTE, _END_BYTE = b"\xff", b"\xfe"
#: Occurrences that a context needs to be looked at, and the length up to which all are kept.
SUPPORT = 2
KEPT = 1
#: Symbols of a context that its family shares: they decide where it is learned.
FAMILY = 2
#: Text bytes that one scoring group holds, words and windows that one bucket is asked for, and
#: text bytes for one bucket of families.
GROUP_BYTES = 6_000_000
BUCKET_WORDS = 2_000_000
BUCKET_TEXT = 25_000_000
#: Longest stretch of a text that is walked as one row of a batch.
STRETCH = 2048
#: Distinct packed windows that a counting task holds before it passes them on.
HELD = 2_000_000


def _split(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def normal(text: str | None) -> str:
    """Words with A-Z lower-cased, one space between."""
    return b" ".join(_split(text)).decode("utf-8", "surrogatepass")


def _symbol_table(alphabet: np.ndarray) -> bytes:
    table = np.full(256, OTHER, dtype=np.uint8)
    mine = np.flatnonzero(alphabet < 256)
    table[alphabet[mine]] = mine + 4
    table[32], table[_START_BYTE[0]], table[_END_BYTE[0]] = SPACE, START, END
    return table.tobytes()


def symbols(texts: list[str] | list[bytes], alphabet: np.ndarray = ALPHABET,
            ) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each after ``DEPTH`` start symbols and followed by an end symbol.

    Returns the flat symbols and the place of each text's first own symbol; ``alphabet`` holds
    ascending byte values, the k-th having symbol k + 4.
    """
    raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    lead = _START_BYTE * DEPTH
    flat = (lead + (_END_BYTE + lead).join(raw) + _END_BYTE).translate(_symbol_table(alphabet))
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1 + DEPTH
    begin = np.cumsum(sizes) - sizes + DEPTH
    return np.frombuffer(flat if raw else b"", dtype=np.uint8), begin


def text_sizes(flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Own symbols of each text, its end included."""
    return np.diff(np.r_[begin, len(flat) + DEPTH]) - DEPTH


def packed_windows(flat: np.ndarray) -> np.ndarray:
    """Every own symbol with the ``DEPTH`` symbols before it, packed, the symbol lowest."""
    n = max(0, len(flat) - DEPTH)
    code = np.zeros(n, dtype=np.int64)
    for k in range(DEPTH + 1):
        code <<= BITS
        code |= flat[k:k + n]
    return code[flat[DEPTH:] != START]


def _low(code: np.ndarray, k: int) -> np.ndarray:
    """Contexts of length ``k`` with the symbol, of packed windows."""
    return code & ((1 << BITS * (k + 1)) - 1)


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each window among the distinct ones in order of first sight, and those."""
    return pd.factorize(code)


def _entries(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of several tables, ascending, and the entry of each row of them."""
    code = np.concatenate([np.zeros(0, np.int64), *codes])
    order = np.argsort(code)
    code = code[order]
    new = np.r_[True, code[1:] != code[:-1]][:len(code)]
    of = np.empty(len(code), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return code[new], of


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several (code, count) tables, ascending."""
    names, of = _entries([c for c, _ in held])
    total = np.zeros(len(names), dtype=np.int64)
    np.add.at(total, of, np.concatenate([np.zeros(0, np.int64), *(n for _, n in held)]))
    return names, total


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[bytes]]:
    for batch in batches:
        texts = [b" ".join(_split(t)) for t in batch.column(column).to_pylist()]
        for a, b in steps(texts):
            yield texts[a:b]


def _window_counts(messages: DataFrame) -> DataFrame:
    """``code, n``: every packed window of the texts with its count so far in the task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(("code", "n"), _added(held), strict=True)))
        for texts in _texts(batches, "text"):
            of, code = _distinct(packed_windows(symbols(texts)[0]))
            held.append((code, np.bincount(of, minlength=len(code))))
            if sum(len(c) for c, _ in held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()
    return messages.select("text").mapInArrow(count, "code long, n long")


def _pair_counts(messages: DataFrame) -> np.ndarray:
    """How often each symbol follows each: one table of the symbols squared, whatever the input."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH * WIDTH, dtype=np.int64)
        for texts in _texts(batches, "text"):
            flat = symbols(texts)[0].astype(np.int64)
            pair = flat[DEPTH - 1:-1] * WIDTH + flat[DEPTH:]
            total += np.bincount(pair[flat[DEPTH:] != START], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": seen, "n": total[seen]})
    rows = (messages.select("text").mapInArrow(count, "code long, n long")
            .groupBy("code").agg(F.sum("n").alias("n")).toArrow())
    pairs = np.zeros(WIDTH * WIDTH)
    pairs[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return pairs.reshape(WIDTH, WIDTH)


@dataclass(frozen=True)
class SuffixTree:
    """The tree as an automaton: next state and log10 probability for each state and symbol."""

    alphabet: np.ndarray
    step: np.ndarray
    logp: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each normalised text, its end included.

        Texts are walked side by side, one symbol of each at a time.  Long ones are walked as
        several stretches; ``DEPTH`` symbols of lead-in bring each to its exact state.
        """
        flat, begin = symbols(texts, self.alphabet)
        sizes = text_sizes(flat, begin)
        parts = -(-sizes // STRETCH)
        starts, text = ragged(parts)
        nth = np.arange(len(text)) - starts[text]
        at = begin[text] + nth * STRETCH
        left = np.minimum(sizes[text] - nth * STRETCH, STRETCH)
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        state = np.zeros(len(at), dtype=np.int64)
        for k in range(DEPTH, 0, -1):
            state = self.step[state, flat[at - k]]
        total = np.zeros(len(at))
        live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
        for k, m in enumerate(live):
            symbol = flat[at[:m] + k]
            total[:m] += self.logp[state[:m], symbol]
            state[:m] = self.step[state[:m], symbol]
        out = np.zeros(len(texts))
        np.add.at(out, text[order], total)
        return out


def _root(counts: np.ndarray) -> np.ndarray:
    first = counts + 0.5
    first[START] = 0.0
    return first / first.sum()


def _by_chance(kinds: np.ndarray) -> np.ndarray:
    """What twice the log likelihood ratio of a context stays below without a reason."""
    return kinds + 4 * np.sqrt(2 * kinds)


def build_tree(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], alphabet: np.ndarray,
               ) -> SuffixTree:
    """The automaton from ``levels[k] = (context, symbol, count)`` of contexts of length k.

    One machine builds it, for a small tree; ``Family`` learns the same without it.

    A context is retained if its next-symbol distribution diverges from that of the context one
    symbol shorter: twice its count times the Kullback-Leibler divergence must pass the range that
    chance explains at its degrees of freedom; those of ``KEPT`` symbols are retained without it.
    Suffixes of retained contexts are retained; their prefixes are states too, which speak with the
    voice of their longest retained suffix.
    Distributions are smoothed towards the shorter context's by Witten-Bell.
    """
    width = len(alphabet) + 4
    counts: list[dict[str, np.ndarray]] = []
    for context, symbol, count in levels:
        names, row = np.unique(context, return_inverse=True)
        table = np.zeros((len(names), width), dtype=np.float32)
        table[row, symbol] = count
        counts.append({"code": names, "n": table})
    root = counts[0]["n"][0].astype(np.float64) if len(counts[0]["code"]) else np.zeros(width)
    smooth = [_root(root)[None, :]]
    retained: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
    parents = np.zeros(1, dtype=np.int64)
    for k in range(1, len(counts)):
        code, n = counts[k]["code"], counts[k]["n"]
        shorter = code & ((1 << BITS * (k - 1)) - 1)
        slot = np.minimum(np.searchsorted(parents, shorter), len(parents) - 1)
        known = parents[slot] == shorter
        code, n, slot = code[known], n[known], slot[known]
        base = smooth[k - 1][slot]
        total = n.sum(axis=1, keepdims=True, dtype=np.float64)
        kinds = np.maximum((n > 0).sum(axis=1, keepdims=True), 1)
        share = n / np.maximum(total, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            diverged = 2 * total[:, 0] * np.where(n > 0, share * np.log(share / base), 0).sum(1)
        keep = (diverged > _by_chance(kinds[:, 0])) | (k <= KEPT)
        smooth.append((n + kinds * base) / (total + kinds))
        retained.append(code[keep])
        parents = code
        counts[k]["code"] = code
    for k in range(len(retained) - 1, 1, -1):
        suffixes = retained[k] & ((1 << BITS * (k - 1)) - 1)
        retained[k - 1] = np.union1d(retained[k - 1], suffixes)
    states = [r.copy() for r in retained]
    for k in range(len(states) - 1, 1, -1):
        states[k - 1] = np.union1d(states[k - 1], states[k] >> BITS)
    base_id = np.cumsum([0, *map(len, states)])
    step = np.zeros((base_id[-1], width), dtype=np.int32)
    logp = np.zeros((base_id[-1], width), dtype=np.float32)
    for k, code in enumerate(states):
        mine = np.arange(base_id[k], base_id[k + 1])
        if k:
            suffix = base_id[k - 1] + np.searchsorted(states[k - 1],
                                                      code & ((1 << BITS * (k - 1)) - 1))
            step[mine], logp[mine] = step[suffix], logp[suffix]
        own = np.isin(code, retained[k])
        with np.errstate(divide="ignore"):
            logp[mine[own]] = np.log10(smooth[k][np.searchsorted(counts[k]["code"], code[own])]
                                       if k else smooth[0])
        if k + 1 < len(states):
            child = states[k + 1]
            step[base_id[k] + np.searchsorted(code, child >> BITS),
                 child & ((1 << BITS) - 1)] = base_id[k + 1] + np.arange(len(child))
    logp[:, OTHER] -= np.float32(math.log10(0x110000))
    return SuffixTree(alphabet, step, logp)


class Family:
    """Learns the contexts of some families, and answers with log10 probabilities of windows.

    The result is that of ``build_tree``: the longest retained suffix of a window's context
    speaks.  ``pairs`` gives the contexts of no and of one symbol.
    """

    def __init__(self, pairs: np.ndarray) -> None:
        total = pairs.sum(axis=1, keepdims=True)
        kinds = (pairs > 0).sum(axis=1, keepdims=True)
        root = _root(pairs.sum(axis=0))
        self.smooth = np.where(total >= SUPPORT, (pairs + kinds * root)
                               / np.maximum(total + kinds, 1), root)

    def logp(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of ascending distinct windows and their counts; windows not learned from count 0."""
        cells, of = np.unique(_low(code, KEPT), return_inverse=True)
        smooth = self.smooth[cells >> BITS, cells & ((1 << BITS) - 1)]
        said, levels = smooth[of], []
        for k in range(KEPT + 1, DEPTH + 1):
            shorter = cells
            cells, of = np.unique(_low(code, k), return_inverse=True)
            count = np.bincount(of, weights=n, minlength=len(cells))
            context = cells >> BITS
            head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][:len(context)])
            at = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(cells)]))
            total = np.add.reduceat(count, head)
            kinds = np.add.reduceat(count > 0, head, dtype=np.int64)
            base = smooth[np.searchsorted(shorter, _low(cells, k - 1))]
            known = total >= SUPPORT
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(count > 0, count * np.log(count / total[at] / base), 0)
            keep = known & (2 * np.add.reduceat(part, head) > _by_chance(kinds))
            smooth = np.where(known[at], (count + kinds[at] * base)
                              / np.maximum(total + kinds, 1)[at], base)
            levels.append((context[head], keep, at[of], smooth[of]))
        for k in range(len(levels) - 1, 0, -1):  # suffixes of retained contexts are retained
            context, keep = levels[k][:2]
            ends = np.unique(context[keep] & ((1 << BITS * (k + KEPT)) - 1))
            levels[k - 1][1][np.searchsorted(levels[k - 1][0], ends)] = True
        for _, keep, at, smooth in levels:
            said = np.where(keep[at], smooth, said)
        return np.log10(said).astype(np.float32)


@dataclass(frozen=True)
class FittedTree:
    """A tree by the texts it is learned from; ``score_messages`` learns it family by family."""

    messages: DataFrame

    @cached_property
    def local(self) -> SuffixTree:
        """The tree as one automaton, for a small table: all its contexts reach the driver."""
        windows = _window_counts(self.messages).groupBy("code").agg(F.sum("n").alias("n"))
        rows = windows.toArrow()
        code, n = (rows.column(c).to_numpy() for c in ("code", "n"))
        levels = []
        for k in range(DEPTH + 1):
            cells, count = _added([(_low(code, k), n)])
            names, of = np.unique(cells >> BITS, return_inverse=True)
            held = np.bincount(of, weights=count, minlength=len(names))[of] >= SUPPORT
            cells, count = cells[held], count[held]
            levels.append((cells >> BITS, cells & ((1 << BITS) - 1), count))
        return build_tree(levels, ALPHABET)

    @property
    def alphabet(self) -> np.ndarray:
        return self.local.alphabet

    @property
    def step(self) -> np.ndarray:
        return self.local.step

    @property
    def logp(self) -> np.ndarray:
        return self.local.logp

    def score(self, texts: list[str]) -> np.ndarray:
        return self.local.score(texts)


def fit_suffix_tree(messages: DataFrame) -> FittedTree:
    """The tree of all bodies of ``messages(text)``.  Nothing is learned before it is used."""
    return FittedTree(messages.select("text"))


_ASK = "grp long, bucket long, hashes binary, counts binary"
_SUM = "bucket long, family long, codes binary, counts binary"
_MODEL = "bucket long, codes binary, logp binary"
_TOLD = "grp long, bucket long, totals binary, tokens long, kinds long"
_END_WORD = b" "
#: The group of windows that are learned from and not asked for.
_NO_GROUP = -1


def _spread(values: np.ndarray, into: int) -> np.ndarray:
    """A bucket for each packed value."""
    mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(into)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Eight-byte numbers, byte rank by byte rank: ascending ones compress to half as they lie."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T).view("<i8")
            .ravel() for x in table.column(column).to_pylist()]


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by bucket, and (bucket, from, to) of those that hold something."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    edges = [*first.tolist(), len(order)]
    return order, list(zip(names.tolist(), edges[:-1], edges[1:], strict=True))


def _windows(texts: list[bytes], train: np.ndarray | None = None):
    """(distinct windows ascending, learned count of each, per step the distinct windows' entries,
    the texts' windows as numbers of those, and the texts' sizes)."""
    held, each = [], []
    for a, b in steps(texts):
        flat, begin = symbols(texts[a:b])
        of, code = _distinct(packed_windows(flat))
        sizes = text_sizes(flat, begin)
        count = np.zeros(len(code), dtype=np.int64)
        if train is not None:
            count = np.bincount(of[np.repeat(train[a:b], sizes)], minlength=len(code))
        held.append((code, count))
        each.append((of.astype(np.int32), sizes))
    names, entry = _entries([c for c, _ in held])
    total = np.zeros(len(names), dtype=np.int64)
    np.add.at(total, entry, np.concatenate([n for _, n in held]))
    cuts = np.cumsum([0, *(len(c) for c, _ in held)])
    return names, total, [(entry[a:b], *rest) for a, b, rest in zip(
        cuts[:-1], cuts[1:], each, strict=True)]


def _asked_windows(grp: int, first: int, buckets: int, code: np.ndarray, n: np.ndarray,
                   ) -> pa.Table:
    order, cuts = _cuts(_spread(code, buckets))
    code, n = code[order], n[order]
    return pa.table({
        "grp": pa.array([grp] * len(cuts), pa.int64()),
        "bucket": pa.array([first + k for k, _, _ in cuts], pa.int64()),
        "hashes": pa.array([_pack(code[a:b]) for _, a, b in cuts], pa.binary()),
        "counts": pa.array([_pack(n[a:b]) for _, a, b in cuts], pa.binary())})


def _arrays(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=kind) for x in table.column(column).to_pylist()]


def _together(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def _words(texts: list[str | None], buckets: int):
    """Tokens of a group: (row starts, word of each token, order by bucket and hash, bucket ends,
    hashes in that order).  The end is the one word that holds a blank."""
    words = [[*_split(t), _END_WORD] for t in texts]
    starts, _ = ragged(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    flat = pa.array(chain.from_iterable(words), pa.large_binary(),
                    size=int(starts[-1])).dictionary_encode()
    code, names = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 0) for w in names), dtype=np.uint64, count=len(names))
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    joined = [b" ".join(ws[:-1]) for ws in words]
    return starts, code, order, ends, hashes[order], joined


def score_messages(messages: DataFrame, tree: FittedTree | None = None,
                   learned: str = "learned") -> DataFrame:
    """Base and tree scores of every body of ``messages(rowid, text, learned)``.

    Returns ``rowid, learned, n_tokens, n_known, train_tokens, base_score, score``.  Tokens are
    the words with A-Z lower-cased and one end.  The base counts tokens over all rows with
    ``learned``: ``log10((c + 0.1) / (N + 0.1 * (V + 1)))`` summed.  ``score`` is the tree's log10
    probability of the words with one space between, and the end; without ``tree`` it learns from
    the rows with ``learned`` as the base does, in the same pass.

    No word table and no tree is broadcast. Texts are grouped by hash; a group asks for each of its
    distinct words once, in buckets of the word's hash, and every bucket answers each group with
    totals in the order asked. A common word is thus one entry per group, wherever it stands, and
    the same shuffle of the texts serves both the questions and the scores. Words go by 64-bit hash.
    Windows of ``DEPTH`` + 1 symbols are asked for alike; their buckets sum the counts, pass each
    distinct window to its family, where the contexts are learned, and hand on what that says.

    NULL and empty bodies are the end alone; without learned rows all counts are zero; repeated
    rows and rows without an id are scored each, equal bodies alike, so there are no ties to settle;
    texts are read whole; an empty table gives an empty table.
    """
    size = messages.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))
    buckets = max(1, math.ceil(size / 6 / BUCKET_WORDS))
    spreads = families = max(1, math.ceil(size / BUCKET_TEXT))
    pairs = _pair_counts(tree.messages if tree else messages.filter(F.col(learned)))
    shared = messages.sparkSession.sparkContext.broadcast(pairs)
    own = tree is None
    rows = messages.select(
        F.pmod(F.xxhash64("rowid", "text"), F.lit(groups)).cast("long").alias("grp"),
        F.col("rowid").cast("long"), "text", F.col(learned).cast("boolean").alias("learned"))

    def ask(group: pa.Table) -> pa.Table:
        starts, code, order, ends, hashes, joined = _words(
            group.column("text").to_pylist(), buckets)
        train = np.array(group.column("learned").to_pylist(), dtype=bool)
        n = np.bincount(code[np.repeat(train, np.diff(starts))], minlength=len(order))[order]
        cuts = list(zip(ends[:-1], ends[1:], strict=True))
        grp = group.column("grp")[0].as_py()
        words = pa.table({
            "grp": pa.array([grp] * buckets, pa.int64()),
            "bucket": pa.array(range(buckets), pa.int64()),
            "hashes": pa.array([hashes[a:b].tobytes() for a, b in cuts], pa.binary()),
            "counts": pa.array([n[a:b].astype("<i8").tobytes() for a, b in cuts], pa.binary())})
        window, count, _ = _windows(joined, train if own else np.zeros_like(train))
        return pa.concat_tables([words, _asked_windows(grp, buckets, spreads, window, count)])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _asked_windows(
                _NO_GROUP, buckets, spreads, batch.column("code").to_numpy(),
                batch.column("n").to_numpy()).to_batches()

    def sum_up(bucket: pa.Table) -> pa.Table:
        if bucket.column("bucket")[0].as_py() < buckets:
            bucket = bucket.slice(0, 0)
        asked, counts = _unpacked(bucket, "hashes"), _unpacked(bucket, "counts")
        code, n = _added(list(zip(asked, counts, strict=True)))
        tail = (code >> BITS) & ((1 << BITS * FAMILY) - 1)
        order, cuts = _cuts(_spread(tail, families))
        code, n = code[order], n[order]
        return pa.table({
            "bucket": pa.array(bucket.column("bucket").to_pylist()[:1] * len(cuts), pa.int64()),
            "family": pa.array([k for k, _, _ in cuts], pa.int64()),
            "codes": pa.array([_pack(code[a:b]) for _, a, b in cuts], pa.binary()),
            "counts": pa.array([_pack(n[a:b]) for _, a, b in cuts], pa.binary())})

    def learn(family: pa.Table) -> pa.Table:
        asked, counts = _unpacked(family, "codes"), _unpacked(family, "counts")
        code = np.concatenate(asked)
        order = np.argsort(code, kind="stable")
        said = np.empty(len(code), dtype="<f4")
        said[order] = Family(shared.value).logp(
            code[order], np.concatenate(counts)[order].astype(np.float64))
        cuts = np.cumsum([0, *map(len, asked)])
        return pa.table({
            "bucket": family.column("bucket"), "codes": family.column("codes"),
            "logp": pa.array([said[a:b].tobytes() for a, b in zip(
                cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def tell(bucket: pa.Table, model: pa.Table) -> pa.Table:
        at = bucket.column("bucket")[0].as_py()
        if at >= buckets:
            bucket = bucket.filter(pc.not_equal(bucket.column("grp"), _NO_GROUP))
            asked = _unpacked(bucket, "hashes")
            code = _together(_unpacked(model, "codes"), "<i8")
            order = np.argsort(code, kind="stable")
            code, logp = code[order], _together(_arrays(model, "logp", "<f4"), "<f4")[order]
            answers = [logp[np.searchsorted(code, a)].tobytes() for a in asked]
            tokens = kinds = 0
        else:
            asked = _arrays(bucket, "hashes", np.uint64)
            names, of = np.unique(np.concatenate(asked), return_inverse=True)
            total = np.zeros(len(names), dtype=np.int64)
            np.add.at(total, of, np.concatenate(_arrays(bucket, "counts", "<i8")))
            cuts = np.cumsum([0, *map(len, asked)])
            answers = [total[of[a:b]].tobytes()
                       for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            tokens, kinds = int(total.sum()), int((total > 0).sum())
        size = bucket.num_rows
        return pa.table({
            "grp": bucket.column("grp"), "bucket": bucket.column("bucket"),
            "totals": pa.array(answers, pa.binary()),
            "tokens": pa.array([tokens] * size, pa.int64()),
            "kinds": pa.array([kinds] * size, pa.int64())})

    def score(group: pa.Table, told: pa.Table) -> pa.Table:
        starts, code, order, _, _, joined = _words(group.column("text").to_pylist(), buckets)
        told = told.sort_by("bucket")
        answers = told.column("totals").to_pylist()
        totals = np.empty(len(order), dtype=np.int64)
        totals[order] = np.frombuffer(b"".join(answers[:buckets]), dtype=np.int64)
        tokens = sum(told.column("tokens").to_pylist())
        kinds = sum(told.column("kinds").to_pylist())
        each = np.log10((totals + 0.1) / (tokens + 0.1 * (kinds + 1)))
        window, _, parts = _windows(joined)
        logp = np.empty(len(window))
        logp[_cuts(_spread(window, spreads))[0]] = np.frombuffer(
            b"".join(answers[buckets:]), dtype="<f4")
        tree_score = np.concatenate([
            np.add.reduceat(logp[entry][of], np.cumsum(sizes) - sizes)
            for entry, of, sizes in parts])
        return pa.table({
            "rowid": group.column("rowid"), "learned": group.column("learned"),
            "n_tokens": pa.array(np.diff(starts), pa.int64()),
            "n_known": pa.array(per_row_sum(totals[code] > 0, starts), pa.int64()),
            "train_tokens": pa.array([tokens] * len(joined), pa.int64()),
            "base_score": [float(x) for x in np.add.reduceat(each[code], starts[:-1])],
            "score": tree_score})

    asked = rows.groupBy("grp").applyInArrow(ask, _ASK)
    if tree:
        asked = asked.union(_window_counts(tree.messages).mapInArrow(give, _ASK))
    model = (asked.groupBy("bucket").applyInArrow(sum_up, _SUM)
             .groupBy("family").applyInArrow(learn, _MODEL))
    told = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(tell, _TOLD)
    return rows.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(
        score, "rowid long, learned boolean, n_tokens long, n_known long, train_tokens long, "
               "base_score double, score double")
