"""Quality of message texts: a sparse ensemble of tree rules, compiled into column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.texts import per_row_sum, ragged, text_columns, word_bytes

#: Labelled rows that are fitted on at most: the ones whose id hashes lowest.
SAMPLE_ROWS = 10_000

# --- fixed values: what the statistics count ---------------------------------------------
BLANKS = " \t\n\x0b\x0c\r"
MARKS = "#*$%&|<>"
STOPS = ".,;:?"
# --- end of fixed values --------------------------------------------------------------------

_KINDS = ("blank", "digit", "capital", "letter", "mark", "stop", "bang", "wide")
#: Statistics of a body, in the order in which rules name them.
STATISTICS = ("word_length", "log_words", "distinct_word_share", "distinct_line_share",
              "words_per_line", "mark_share", "stop_share", "bang_share", "digit_share",
              "capital_share", "letter_share", "wide_share")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """One bit per kind for every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        c = chr(code)
        flags = (c in BLANKS, c.isdigit(), c.isupper(), c.isalpha(), c in MARKS, c in STOPS,
                 c == "!", code > 127)
        table[code] = sum(1 << k for k, on in enumerate(flags) if on)
    return table


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The statistics of each text; shares of nothing are zero."""
    chars = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts, _ = ragged(chars)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flags = _kinds()[code]
    n = {kind: per_row_sum((flags >> k) & 1, starts).astype(np.float64)
         for k, kind in enumerate(_KINDS)}
    words = [word_bytes(t) for t in texts]
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
    n |= {"char": chars.astype(np.float64)}
    n |= {name: np.fromiter(map(len, rows), dtype=np.float64, count=len(texts))
          for name, rows in (("word", words), ("distinct_word", map(set, words)),
                             ("line", lines), ("distinct_line", map(set, lines)))}

    def share(a: np.ndarray, b: str) -> np.ndarray:
        return a / np.maximum(n[b], 1)

    return dict(zip(STATISTICS, (
        share(n["char"] - n["blank"], "word"), np.log1p(n["word"]),
        share(n["distinct_word"], "word"), share(n["distinct_line"], "line"),
        share(n["word"], "line"), share(n["mark"], "char"), share(n["stop"], "word"),
        share(n["bang"], "word"), share(n["digit"], "char"), share(n["capital"], "letter"),
        share(n["letter"], "char"), share(n["wide"], "char")), strict=True))


def statistics(messages: DataFrame, *keep: str) -> DataFrame:
    """``rowid``, the columns ``keep`` and the statistics of each body."""
    column = text_columns(", ".join(f"{name} double" for name in STATISTICS), measure)
    return messages.select("rowid", *keep, column("text").alias("s")).select(
        "rowid", *keep, "s.*")


@dataclass(frozen=True)
class Rule:
    """A tree path: all of its (statistic, at most?, threshold) tests hold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, below, cut in self.tests:
            out = out & ((F.col(name) <= cut) if below else (F.col(name) > cut))
        return out

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, below, cut in self.tests:
            v = x[:, STATISTICS.index(name)]
            out &= (v <= cut) if below else (v > cut)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with their weights; the score is the logistic of intercept plus weights that hold."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = field(default=())

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def bin_edges(x: np.ndarray, cuts: int = 24) -> list[np.ndarray]:
    """Candidate thresholds of each statistic: its quantiles."""
    return [np.unique(np.quantile(v, np.linspace(0.02, 0.98, cuts))) for v in x.T]


def grow_paths(binned: np.ndarray, y: np.ndarray, edges: list[np.ndarray],
               rng: np.random.Generator, depth: int = 3, least: int = 8) -> list[Rule]:
    """Paths to every node of one tree, grown by Gini gain on a random part of the statistics.

    ``binned`` holds for each value the number of thresholds below it.
    """
    out: list[Rule] = []

    def grow(rows: np.ndarray, tests: tuple) -> None:
        if tests:
            out.append(Rule(tests))
        share = y[rows].mean()
        if len(tests) == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return
        best = (1e-9, -1, -1)
        for j in rng.permutation(len(edges))[:max(3, len(edges) // 2)]:
            v = binned[rows, j]
            n = np.bincount(v, minlength=len(edges[j]) + 1).cumsum()[:-1]
            good = np.bincount(v, weights=y[rows], minlength=len(edges[j]) + 1).cumsum()[:-1]
            rest = len(rows) - n
            ok = (n >= least) & (rest >= least)
            if ok.any():
                a, b = good[ok] / n[ok], (share * len(rows) - good[ok]) / rest[ok]
                mixed = (n[ok] * a * (1 - a) + rest[ok] * b * (1 - b)) / len(rows)
                k = int(mixed.argmin())
                gain = share * (1 - share) - mixed[k]
                if gain > best[0]:
                    best = (gain, int(j), int(np.flatnonzero(ok)[k]))
        if best[1] >= 0:
            _, j, k = best
            left, cut = binned[rows, j] <= k, float(edges[j][k])
            grow(rows[left], (*tests, (STATISTICS[j], True, cut)))
            grow(rows[~left], (*tests, (STATISTICS[j], False, cut)))

    grow(rng.integers(0, len(y), len(y)), ())
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 250,
                   ) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the logistic loss plus an L1 penalty (FISTA)."""
    n, k = x.shape
    step = 1.0 / (0.25 * (np.linalg.norm(x, 2) ** 2 / n + 1.0))
    w = v = np.zeros(k + 1)
    t = 1.0
    for _ in range(rounds):
        z = 1.0 / (1.0 + np.exp(-np.clip(v[0] + x @ v[1:], -35, 35)))
        grad = np.r_[(z - y).mean(), x.T @ (z - y) / n]
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0.0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, seed: int = 7) -> RuleEnsemble:
    """Grow trees, turn their paths into 0/1 columns, weigh them by a lasso logistic fit.

    The penalty is the strongest of a fixed ladder whose held-back loss is within one standard
    error of the best.  Fewer than two classes give the smoothed share of good rows to all.
    """
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    flat = RuleEnsemble(float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2 or len(y) < 20:
        return flat
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.25
    edges = bin_edges(x[~held])
    binned = np.stack([np.searchsorted(e, v) for e, v in zip(edges, x[~held].T, strict=True)],
                      axis=1)
    rules = list(dict.fromkeys(r for _ in range(trees)
                               for r in grow_paths(binned, y[~held], edges, rng)))
    masks = np.stack([r.holds(x) for r in rules], axis=1) if rules else None
    if masks is None or len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        return flat
    _, first = np.unique(masks, axis=1, return_index=True)
    rules, f = [rules[i] for i in sorted(first)], masks[:, sorted(first)].astype(np.float64)
    fits = []
    for penalty in (0.03, 0.01, 0.003, 0.001):
        b, w = lasso_logistic(f[~held], y[~held], penalty)
        z = np.clip(b + f[held] @ w, -35, 35)
        loss = np.logaddexp(0, z) - y[held] * z
        fits.append((loss.mean(), loss.std() / math.sqrt(len(loss)), penalty))
    low = min(fits)
    penalty = next(p for loss, _, p in fits if loss <= low[0] + low[1])
    b, w = lasso_logistic(f, y, penalty)
    return RuleEnsemble(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True)
                                 if abs(v) > 1e-6))


def fit_rule_ensemble(messages: DataFrame, verdicts: DataFrame, most: int = SAMPLE_ROWS,
                      ) -> RuleEnsemble:
    """Learn from ``verdicts(rowid, keep)``, 0/1, which bodies of ``messages`` are worth keeping.

    At most ``most`` verdicts are used, those whose rowid hashes lowest, so the sample does not
    depend on how rows are laid out and what reaches the driver is bounded: one row of numbers
    each.  NULL verdicts are left out; several of one rowid count by their mean; ids whose hashes tie
    are ordered by the id.
    """
    sample = (verdicts.filter("keep IS NOT NULL AND rowid IS NOT NULL").groupBy("rowid")
              .agg((F.avg("keep") >= 0.5).cast("double").alias("keep"))
              .orderBy(F.xxhash64("rowid"), "rowid").limit(most))
    rows = (messages.select("rowid", "text").join(F.broadcast(sample), "rowid"))
    table = statistics(rows, "keep").drop("rowid").toPandas()
    table = table.sort_values(list(table.columns), ignore_index=True)
    return fit_rules(table[[*STATISTICS]].to_numpy(dtype=np.float64),
                     table["keep"].to_numpy(dtype=np.float64))


def rate_messages(messages: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``rowid, score, predicted`` of every message body.

    ``messages``: ``rowid, text`` (other columns are ignored).  The statistics of a batch are
    counted in one vectorised pass; the rules are column expressions over them.

    NULL counts as empty, and an empty body is scored on zero counts; repeated rows and rows without
    an id are scored each, equal bodies alike; a body is read whole at any length; a score of exactly
    one half is predicted 1; an empty table gives an empty table.
    """
    rated = statistics(messages).select("rowid", model.score().alias("score"))
    return rated.select("rowid", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
