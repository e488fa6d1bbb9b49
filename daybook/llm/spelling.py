"""Spelling variants among the words of message texts, found with a bidirectional FM-index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.session import durable

#: A word of message texts.
WORD = r"([A-Za-z\x{C0}-\x{FF}]+)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters, delimiters included, that one index holds at most but for a longer word.
INDEX_LETTERS = 500_000
#: Words searched side by side, and places of the transformed text between two stored ranks.
SEARCHED, STRIDE = 8_192, 16


def _rotations(codes: np.ndarray, letters: int) -> np.ndarray:
    """Starts of the rotations of a circular text in sorted order, by doubling."""
    n, bits = len(codes), max(1, (letters - 1).bit_length())
    width, rank = 60 // bits, np.zeros(len(codes), dtype=np.int64)
    for k in range(width):
        rank = (rank << bits) | np.roll(codes, -k)
    while True:
        order = np.argsort(rank, kind="stable")
        known = rank[order]
        place = np.zeros(n, dtype=np.int64)
        place[order] = np.concatenate([[0], np.cumsum(known[1:] != known[:-1])])
        if place[order[-1]] == n - 1:
            return order
        rank, width = place * n + np.roll(place, -width), 2 * width


class _Side:
    """One direction: the last column of the sorted rotations and ranks of its letters."""

    def __init__(self, codes: np.ndarray, letters: int) -> None:
        self.starts, n = _rotations(codes, letters), len(codes)
        column = codes[self.starts - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(column, minlength=letters))])[:-1]
        blocks = n // STRIDE + 1
        held = np.bincount(np.arange(n) // STRIDE * letters + column, minlength=blocks * letters)
        held = np.cumsum(held.reshape(blocks, letters), axis=0, dtype=np.int32)
        self.ranks = np.concatenate([np.zeros((1, letters), np.int32), held[:-1]])
        self.column = np.full((blocks, STRIDE), letters, dtype=np.min_scalar_type(letters))
        self.column.reshape(-1)[:n] = column
        self.until = np.arange(STRIDE)

    def rank(self, place: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """How often each letter stands before each place of the last column."""
        block = place // STRIDE
        rest = self.until < (place - block * STRIDE)[:, None]
        return self.ranks[block, letter] + (
            (self.column[block] == letter[:, None]) & rest).sum(axis=1)

    def rank_all(self, place: np.ndarray) -> np.ndarray:
        """How often every letter stands before each place: one row a place."""
        block = place // STRIDE
        counts, offset = self.ranks[block], place - block * STRIDE
        for k in range(STRIDE - 1):
            reach = np.flatnonzero(offset > k)
            counts[reach, self.column[block[reach], k]] += 1
        return counts


class BidirectionalIndex:
    """Suffix-rank intervals over distinct words, each between delimiters, extended either way.

    ``codes`` has one row a word, letters from 1, padded with the delimiter 0.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, letters: int) -> None:
        spans = np.concatenate([np.zeros((len(codes), 1), codes.dtype), codes], axis=1)
        held = np.arange(spans.shape[1]) <= lengths[:, None]
        text = spans[held].astype(np.int64)
        self.size = len(text)
        self.word_at = np.cumsum(text == 0) - 1
        self.words = len(codes)
        self.left = _Side(text, letters)             # extends a pattern to the left
        self.right = _Side(text[::-1].copy(), letters)

    def half(self, halves: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of whole halves, delimiter last, in the side that goes on from there.

        With ``left`` a half is the beginning of a word, matched from its last letter to the
        delimiter before it; without, the ending, matched from its first letter to the one behind.
        The ranks of the other side follow from the letters that are smaller.
        """
        side = self.left if left else self.right
        low = np.zeros(len(halves), dtype=np.int64)
        other, size = low.copy(), low + self.size
        for letter in halves.T:
            before, behind = side.rank_all(low), side.rank_all(low + size)
            within, row = np.cumsum(behind - before, axis=1), np.arange(len(low))
            size = (behind - before)[row, letter].astype(np.int64)
            other = other + within[row, letter] - size
            low = side.first[letter] + before[row, letter]
        return other, size

    def found(self, low: np.ndarray, left: bool) -> np.ndarray:
        """Words of completed intervals of the side that has gone on."""
        if left:                        # read to the right: the start is the delimiter behind
            behind = self.size - 1 - self.right.starts[low]
            return (self.word_at[behind] - 1) % self.words
        return self.word_at[self.left.starts[low]]


def _one_error(side: _Side, rest: np.ndarray, longer: np.ndarray, low: np.ndarray,
               size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, final row) of all words that continue an interval as ``rest`` with one error.

    ``rest`` is what each query has left, padded with delimiters, of which the first ends the
    word.  A query that is ``longer`` may have a letter replaced or left out, any other one put
    in.  Of equal neighbours only the last is left out, and a letter is put in only where the next
    one differs, so every word is found by one way.
    """
    query, ended = np.arange(len(rest)), []
    once = [np.zeros(0, dtype=np.int64)] * 3                    # query, low, high after the error
    for k in range(rest.shape[1]):
        low_all, high_all = side.rank_all(low), side.rank_all(low + size)
        many, letter = high_all - low_all, rest[query, k].astype(np.int64)
        may = longer[query] & (letter != 0)
        other = many > 0
        other[:, 0] = False
        other[np.arange(len(query)), letter] = False
        put = np.nonzero(other & ~longer[query][:, None])
        swap = np.nonzero(other & may[:, None])

        def onto(at: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
            start = side.first[at[1]]
            return [query[at[0]], start + low_all[at], start + high_all[at]]

        once = [np.concatenate(x) for x in zip(once, onto(put), strict=True)]
        asked = rest[once[0], k].astype(np.int64)
        start = side.first[asked]
        a, b = start + side.rank(once[1], asked), start + side.rank(once[2], asked)
        alive = b > a
        done = alive & (asked == 0)
        ended.append((once[0][done], a[done]))
        alive &= asked != 0
        once = [once[0][alive], a[alive], b[alive]]
        after = rest[query, k + 1] if k + 1 < rest.shape[1] else np.zeros(len(query), rest.dtype)
        drop = np.flatnonzero(may & (letter != after))
        once = [np.concatenate(x) for x in zip(
            once, onto(swap), [query[drop], low[drop], low[drop] + size[drop]], strict=True)]
        row = np.arange(len(query))
        low, size = side.first[letter] + low_all[row, letter], many[row, letter].astype(np.int64)
        goes = (size > 0) & (letter != 0)
        query, low, size = query[goes], low[goes], size[goes]
        if not len(query) and not len(once[0]):
            break
    return tuple(np.concatenate(x) for x in zip(*ended, strict=True))


def near_words(words: list[str], held: np.ndarray, longest: int,
               left: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (searched word, word held by the index) of one error whose longer has ``longest``.

    All words have ``longest`` letters or one less.  With ``left`` the pairs share the first half;
    without, the last half but not the first.
    """
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    letters, flat = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32),
                              return_inverse=True)
    codes = np.zeros((len(words), longest), dtype=np.int32)
    codes[np.arange(longest) < lengths[:, None]] = flat + 1
    mirrored = codes if left else np.where(
        np.arange(longest) < lengths[:, None],
        codes[np.arange(len(words))[:, None], (lengths[:, None] - 1 - np.arange(longest)) % longest], 0)
    index, half = BidirectionalIndex(codes[held], lengths[held], len(letters) + 1), longest // 2
    side = index.right if left else index.left
    pairs = []
    for a in range(0, len(words), SEARCHED):
        mine = mirrored[a:a + SEARCHED]
        halves, which = np.unique(mine[:, half - 1::-1] if half else mine[:, :0], axis=0,
                                  return_inverse=True)
        ended = np.concatenate([halves, np.zeros((len(halves), 1), halves.dtype)], axis=1)
        low, size = (x[which.reshape(-1)] for x in index.half(ended, left))
        alive = np.flatnonzero(size)
        rest = np.concatenate([mine[alive, half:], np.zeros((len(alive), 1), mine.dtype)], axis=1)
        query, row = _one_error(side, rest, lengths[a + alive] == longest, low[alive], size[alive])
        pairs.append((a + alive[query], held[index.found(row, left)]))
    one, other = (np.concatenate(x) for x in zip(*pairs, strict=True))
    if not left:
        new = (codes[one, :half] != codes[other, :half]).any(axis=1)
        one, other = one[new], other[new]
    return one, other


def _group_near(block: pa.Table) -> pa.Table:
    """Per word of the group: near words that its index holds, and the commonest of them."""
    # Two parts of one half may meet here: a word is then asked once, and indexed if one part says so.
    once = block.group_by("word").aggregate([("n", "max"), ("indexed", "max")]).to_pydict()
    words = sorted(once["word"])
    told = dict(zip(once["word"], zip(once["n_max"], once["indexed_max"], strict=True), strict=True))
    n = np.array([told[w][0] for w in words], dtype=np.int64)
    held = np.flatnonzero([told[w][1] for w in words])
    longest, left = (block.column(c)[0].as_py() for c in ("longest", "beginning"))
    none = np.zeros(0, dtype=np.int64)
    one, other = near_words(words, held, longest, left) if len(held) else (none, none)
    best = np.lexsort((other, -n[other], one))
    one, other = one[best], other[best]
    row, at, near = np.unique(one, return_index=True, return_counts=True)
    top = other[at]
    return pa.table({"word": pa.array([words[i] for i in row], pa.string()),
                     "n_near": pa.array(near, pa.int64()), "top_n": pa.array(n[top], pa.int64()),
                     "top": pa.array([words[i] for i in top], pa.string())})


def message_words(messages: DataFrame) -> DataFrame:
    """``rowid, word`` for every run of letters in the bodies, A-Z lower-cased; NULL has none."""
    word = F.explode(F.regexp_extract_all("text", F.lit(WORD), 1))
    return messages.select("rowid", word.alias("word")).select(
        "rowid", F.translate("word", UPPER, UPPER.lower()).alias("word"))


def _near(counts: DataFrame) -> DataFrame:
    """``word, n_near, top`` of the words that have a near one; top is ``(-n, word)``.

    Words one error apart share their first or their last half, measured on the longer.  So a word
    goes to four places: by its first and by its last half, each as the longer and as the shorter
    of a pair.  Places are dealt to groups of bounded letters; one that alone has more is cut into
    parts, each of which is indexed once and asked by all its words.
    """
    half = "cast(longest div 2 AS int)"
    rows = (counts.withColumn("longest", F.explode(F.array(F.length("word"), F.length("word") + 1)))
            .withColumn("beginning", F.explode(F.array(F.lit(True), F.lit(False))))
            .withColumn("half", F.expr(f"if(beginning, left(word, {half}), right(word, {half}))")))
    place = ["beginning", "longest", "half"]
    letters = F.sum(F.col("longest") + 1) / INDEX_LETTERS
    hot = rows.groupBy(*place).agg(F.ceil(letters).cast("int").alias("parts")).filter("parts > 1")
    kinds = rows.groupBy(*place[:2]).agg(F.ceil(letters).alias("groups"))
    dealt = (rows.join(hot, place, "left").join(kinds, place[:2])
             .withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("indexed", F.pmod(F.xxhash64("word"), "parts") == F.col("part"))
             .withColumn("dealt", F.pmod(F.xxhash64("half", "part"), "groups"))
             .select("word", "n", "longest", "beginning", "indexed", "dealt"))
    near = dealt.groupBy("beginning", "longest", "dealt").applyInArrow(
        _group_near, "word string, n_near long, top_n long, top string")
    return near.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("top_n")).alias("less"), F.col("top").alias("word"))).alias("top"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form met from ``word, form``, reached by doubling."""
    roots = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(roots.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return roots


def spelling_variants(words: DataFrame, least_letters: int = 6, least_n: int = 5,
                      times: int = 5) -> DataFrame:
    """Words and the spellings they vary: ``word, n, n_near, form, form_n, root``.

    ``words`` has a column ``word``, one row an occurrence, as :func:`message_words` gives them;
    other columns are ignored.  Kept are words of ``least_letters`` code points or more that occur
    ``least_n`` times or more (``n``).  Two are near if one code point put in, left out or replaced
    makes one the other; ``n_near`` counts a word's.  Its ``form`` is the near word of largest n
    (ties: the first in code-point order) if that is at least ``times`` its own, else NULL; ``root``
    follows the forms to the last and is the word itself if it has none.

    Words are counted map-side first, so a common one is no hot key.  The vocabulary is indexed in
    groups of bounded letters; pairs never leave a group, only a word's count and its best.  A NULL
    word and an empty one are left out; a word of any length is taken whole; repeated rows are
    occurrences; an empty table gives an empty table.
    """
    if times < 2 or least_letters < 2:
        raise ValueError("forms must be commoner than their variants, and words have two halves")
    counts = durable(words.filter(F.length("word") >= least_letters).groupBy("word")
                     .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n))
    chosen = -F.col("top.less") >= times * F.col("n")
    told = durable(counts.join(_near(counts), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("top.word")).alias("form"),
        F.when(chosen, -F.col("top.less")).alias("form_n")))
    roots = _roots(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
