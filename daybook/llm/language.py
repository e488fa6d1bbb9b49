"""Language of message texts: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.llm.texts import steps, text_columns

#: Rows per language, and in all, that are fitted on at most: those whose id hashes lowest.
ROWS_PER_LANGUAGE = 600
ROWS_IN_ALL = 6_000
BUCKET_BITS = 15
WIDTH = 16
SIZES = (2, 3, 4)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def subwords(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(bucket, text number) of every subword, one pair of arrays per length, and which texts
    hold a letter.

    A subword is 2 to 4 consecutive letters of a word, lower-cased, its ends marked.
    """
    if not texts:
        return [], np.zeros(0, dtype=bool)
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in lowered), dtype=np.int64, count=len(texts))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    joined = "\n".join(lowered) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    keep = letter | np.r_[False, letter[:-1]] | np.r_[letter[1:], False]
    symbol = np.where(letter, code, 0)[keep].astype(np.uint64)
    row, inner = row[keep], letter[keep]
    out = []
    for size in SIZES:
        n = len(symbol) - size + 1
        if n <= 0:
            continue
        mixed = symbol[:n].copy()
        whole = inner[:n] | inner[size - 1:size - 1 + n]
        for k in range(1, size):
            mixed *= np.uint64(0x100000001B3)
            mixed += symbol[k:k + n]
            if k < size - 1:
                whole &= inner[k:k + n]
        mixed = (mixed[whole] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), row[1:n + 1][whole]))
    return out, has


@dataclass(frozen=True)
class LanguageModel:
    """Languages, each bucket's share of their logits, offsets, and the calibration."""

    languages: tuple[str, ...]
    table: np.ndarray
    offset: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, has = subwords(texts)
        total = np.zeros(len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        for bucket, owner in found:
            total += np.bincount(owner, minlength=len(texts))
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(owner, weights=self.table[bucket, k],
                                          minlength=len(texts))
        return sums / np.maximum(total, 1)[:, None] + self.offset, has

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        z, has = self.logits(texts)
        z = z / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), has


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def _snippets(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text and short stretches of it, so that short texts are learned too."""
    words = text.split()
    out = [text]
    for size in (4, 15):
        if len(words) > size:
            at = int(rng.integers(0, len(words) - size))
            out.append(" ".join(words[at:at + size]))
    return out


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, share of each) of every text."""
    found, _ = subwords(texts)
    code, times = np.unique(np.concatenate(
        [np.zeros(0, dtype=np.int64),
         *((owner.astype(np.int64) << BUCKET_BITS) | bucket for bucket, owner in found)]),
        return_counts=True)
    starts = np.searchsorted(code >> BUCKET_BITS, np.arange(len(texts) + 1))
    code = (code & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
    return [(code[a:b], (times[a:b] / max(1, times[a:b].sum())).astype(np.float32))
            for a, b in zip(starts[:-1], starts[1:], strict=True)]


def fit_language(texts: list[str], languages: list[str], epochs: int = 3, rate: float = 0.5,
                 seed: int = 5, spared: float = 0.005) -> LanguageModel | None:
    """Train by stochastic gradient descent and calibrate on a fifth of the texts.

    The temperature minimises the calibration loss.  Rejection is set so that at most ``spared``
    of the calibration texts fall under it, and never above one half.
    """
    names = tuple(sorted(set(languages)))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in languages])
    held = rng.random(len(texts)) < 0.2
    if held.all() or not held.any() or len(set(label[~held])) < len(names):
        held[:] = False
    examples, target = [], []
    for i in np.flatnonzero(~held):
        parts = _snippets(texts[i], rng)
        examples += parts
        target += [label[i]] * len(parts)
    bags = [bag for a, b in steps(examples, 500_000) for bag in _bags(examples[a:b])]
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32)
    offset = np.zeros(len(names), dtype=np.float32)
    total = epochs * len(examples)
    for step, i in enumerate(np.concatenate([rng.permutation(len(examples))
                                             for _ in range(epochs)])):
        distinct, share = bags[i]
        if not len(distinct):
            continue
        now = rate * (1 - step / total)
        mean = share @ vectors[distinct]
        error = _softmax(mean @ weights + offset)
        error[target[i]] -= 1.0
        back = weights @ error
        weights -= now * np.outer(mean, error)
        offset -= now * error * 0.1
        vectors[distinct] -= now * len(distinct) ** 0.5 * share[:, None] * back
    model = LanguageModel(names, vectors @ weights, offset, 1.0, 0.0)
    checked = np.flatnonzero(held)
    if not len(checked):
        return model
    parts = [model.logits([texts[i] for i in checked[a:b]])
             for a, b in steps([texts[i] for i in checked], 500_000)]
    z, has = (np.concatenate(p) for p in zip(*parts, strict=True))
    z, truth = z[has], label[checked][has]
    if not len(z):
        return model
    ladder = 2.0 ** np.arange(-5, 4)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean()
            for t in ladder]
    temperature = float(ladder[int(np.argmin(loss))])
    top = np.sort(_softmax(z / temperature).max(axis=1))
    return LanguageModel(names, model.table, offset, temperature,
                         float(min(0.5, top[int(spared * len(top))])))


def fit_message_language(messages: DataFrame, language: str = "language",
                         most: int = ROWS_PER_LANGUAGE) -> LanguageModel | None:
    """Learn from the non-NULL ``language`` of ``messages(rowid, text, language)``.

    At most ``most`` whole bodies per language are used, those whose rowid hashes lowest, and at
    most ``ROWS_IN_ALL``, dealt evenly over the languages; that bound lets the chosen ids be
    broadcast, so no text is shuffled.  The ranking keeps ``most`` per task before its shuffle.
    None if nothing is labelled.
    """
    known = messages.select("rowid", "text", F.col(language).alias("language")).filter(
        "language IS NOT NULL AND text IS NOT NULL")
    ids = known.select("rowid", "language").withColumn("h", F.xxhash64("rowid"))
    top = (ids.withColumn("n", F.row_number().over(
        W.partitionBy("language").orderBy("h", "rowid"))).filter(F.col("n") <= most)
        .orderBy("n", "language", "rowid").limit(ROWS_IN_ALL).select("rowid").distinct())
    rows = known.join(F.broadcast(top), "rowid", "left_semi").orderBy(
        F.xxhash64("rowid"), "rowid", F.xxhash64("text")).limit(ROWS_IN_ALL).collect()
    return fit_language([r["text"] for r in rows], [r["language"] for r in rows])


def language_column(model: LanguageModel | None):
    """text -> struct(lang_pred, score, rejected)."""
    def work(texts: list[str]) -> dict:
        if model is None:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts),
                    "rejected": [True] * len(texts)}
        p, has = model.probabilities(texts)
        best = p.argmax(axis=1) if len(texts) else np.zeros(0, dtype=np.int64)
        score = np.where(has, p.max(axis=1, initial=0.0), 0.0)
        return {"lang_pred": [model.languages[k] if h else UNKNOWN
                              for k, h in zip(best, has, strict=True)],
                "score": score, "rejected": ~has | (score < model.reject_below)}
    return text_columns("lang_pred string, score double, rejected boolean", work)


def identify_languages(messages: DataFrame, model: LanguageModel | None,
                       text: str | Column = "text") -> DataFrame:
    """``rowid, lang_pred, score, rejected`` of every message body.

    ``messages``: ``rowid, text`` (other columns are ignored).  ``score`` is the calibrated
    probability of the language named; ``rejected`` is true below the model's bound.  Map-only.
    A NULL body or one without a letter is ``und`` with score 0 and rejected, as is every body
    if there was nothing to learn from; repeated rows and rows without an id are judged each, long
    bodies whole.  Of languages with the same probability the first by name is given.  An empty
    table gives an empty table.
    """
    told = messages.select("rowid", language_column(model)(text).alias("l"))
    return told.select("rowid", "l.lang_pred", "l.score", "l.rejected")
