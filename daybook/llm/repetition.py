"""Quality rules on message texts from repeats inside one text, found with a suffix array."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.texts import numbered, per_row_sum, ragged, text_columns, word_bytes

# --- fixed values ---------------------------------------------------------------------------
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# --- end of fixed values --------------------------------------------------------------------


@dataclass(frozen=True)
class RepetitionRules:
    """Limits of the rules.

    ``shortest`` is the length in words from which a repeat counts, ``covered`` the largest
    fraction of a text's words that repeats may cover, ``longest`` the longest repeat in words
    as a fraction of the text, counted from ``longest_words`` words on.
    """

    min_words: int = 50
    repeat_percent: int = 50
    shortest: int = 4
    covered: float = 0.30
    longest: float = 0.20
    longest_words: int = 20


def suffix_order(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix arrays of many short sequences at once, by prefix doubling.

    ``codes`` differ between rows, so suffixes of different rows never share a prefix.  Returns
    the suffix order and, for each power of two h, the ranks by the first h symbols; a rank is
    the place of its group's first member.  Only suffixes still in a group are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    change = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    levels, h = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            return order, levels
        after = tied + h
        inside = after < n
        inside[inside] = row[after[inside]] == row[tied[inside]]
        second = np.zeros(len(tied), dtype=np.int64)
        second[inside] = rank[after[inside]] + 1
        by = np.argsort(rank[tied] * np.int64(n + 1) + second, kind="stable")
        tied, second = tied[by], second[by]
        group = rank[tied]
        place = group + np.arange(len(tied)) - np.searchsorted(group, group)
        order[place] = tied
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        fresh = rank.copy()
        fresh[tied] = np.maximum.accumulate(np.where(new, place, 0))
        if (fresh == rank).all() and not inside.any():
            return order, levels
        rank, h = fresh, 2 * h
        levels.append(rank.astype(np.int32))


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray], row: np.ndarray,
                       ) -> np.ndarray:
    """Length of the longest prefix each suffix shares with the one before it in the order."""
    n = len(order)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    common = np.zeros(len(a), dtype=np.int64)
    pair = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pair], b[pair]
    at = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + at, b + at
        ok = (x + (1 << k) <= n) & (y + (1 << k) <= n)
        ok[ok] = ((row[x[ok]] == row[a[ok]]) & (row[y[ok]] == row[b[ok]])
                  & (levels[k][x[ok]] == levels[k][y[ok]])
                  & (row[x[ok] + (1 << k) - 1] == row[a[ok]])
                  & (row[y[ok] + (1 << k) - 1] == row[b[ok]]))
        at += ok * (1 << k)
    common[pair] = at
    return np.r_[0, common] if n else common


def mark_spans(begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """True for every place covered by one of the spans."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, begin, 1)
    np.add.at(delta, begin + length, -1)
    return np.cumsum(delta[:-1]) > 0


def repetition_measures(texts: list[str], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """All measures of a batch of texts; see ``repetition_verdicts``."""
    words = [word_bytes(t) for t in texts]
    n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts, row = ragged(n_words)
    total = int(starts[-1])
    covered = longest = repeated = np.zeros(len(texts), dtype=np.int64)
    if total:
        word, names = numbered(chain.from_iterable(words))
        codes = row * np.int64(len(names)) + word
        order, levels = suffix_order(codes, row)
        before = neighbour_prefixes(order, levels, row)
        best = np.empty(total, dtype=np.int64)
        best[order] = np.maximum(before, np.r_[before[1:], 0])
        begin = np.flatnonzero(best >= rules.shortest)
        covered = per_row_sum(mark_spans(begin, best[begin], total), starts)
        longest = np.maximum.reduceat(np.r_[best, 0], np.minimum(starts[:-1], total))
        longest = np.where(n_words > 0, longest, 0)
        thrice = np.flatnonzero(best >= 3)
        repeated = per_row_sum(mark_spans(thrice, np.full(len(thrice), 3), total), starts)
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
    failed = ((n_words < rules.min_words)
              | (100 * repeated > rules.repeat_percent * n_words))
    share = covered / np.maximum(n_words, 1)
    long_share = np.where(longest >= rules.longest_words, longest / np.maximum(n_words, 1), 0.0)
    return {
        "n_words": n_words,
        "word_chars": [len(t) - sum(map(t.count, BLANKS)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": ~failed & (share <= rules.covered) & (long_share <= rules.longest),
        "covered_fraction": share,
        "longest_repeat": longest,
    }


def repetition_verdicts(messages: DataFrame, rules: RepetitionRules = RepetitionRules(),
                        ) -> DataFrame:
    """Counts and the keep-or-drop verdict of every message body.

    ``messages``: ``rowid, text`` (other columns are ignored).  Per row: ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words inside 3-word
    windows found twice or more), ``base_failed``, ``kept``, ``covered_fraction`` and
    ``longest_repeat``.  The last two come from the body's suffix array over words: the
    longest-common-prefix intervals of ``shortest`` words and more are its maximal repeated
    substrings, and their spans are united.

    Map-only; the texts of a batch share one vectorised suffix sort.  NULL and empty bodies have
    no words and fail; a row stands for itself, so repeated rows repeat and a NULL id is kept; any
    length is read whole.  Repeats of one length all count, so there are no ties to settle.  An empty
    table gives an empty table.
    """
    schema = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, base_failed boolean, kept boolean, covered_fraction double, "
              "longest_repeat long")
    column = text_columns(schema, lambda texts: repetition_measures(texts, rules))
    return messages.select("rowid", column("text").alias("m")).select("rowid", "m.*")
