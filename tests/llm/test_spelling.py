import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from daybook.llm import spelling
from daybook.llm.spelling import BidirectionalIndex, message_words, near_words, spelling_variants

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def one_error(a, b):
    """Whether exactly one code point put in, left out or replaced makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def around(word, letters):
    """All strings one error away."""
    cut = {word[:i] + word[i + 1:] for i in range(len(word))}
    swap = {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return (cut | swap | put) - {word}


def plainly(occurrences, least_letters=6, least_n=5, times=5):
    n = {w: k for w, k in Counter(occurrences).items()
         if w is not None and len(w) >= least_letters and k >= least_n}
    letters, form, rows = {c for w in n for c in w}, {}, {}
    for w in n:
        near = [x for x in around(w, letters) if x in n]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
        rows[w] = len(near)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], rows[w], form[w], None if form[w] is None else n[form[w]], root))
    return sorted(out)


def told(df):
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def noisy(seed, roots, letters, most=300):
    """Occurrences of random words, each with rarer misspellings of itself and of those."""
    rng, out = random.Random(seed), []
    for _ in range(roots):
        word, n = "".join(rng.choices(letters, k=rng.randint(5, 12))), rng.randint(5, most)
        for _ in range(rng.randint(1, 4)):
            out += [word] * n
            out += [x for x in rng.sample(sorted(around(word, letters)), 6)
                    for _ in range(rng.randint(3, 12))]
            word, n = rng.choice(sorted(around(word, letters))), max(1, n // rng.randint(3, 8))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("letters", "seed"), [("ab", 1), ("abé", 2), ("abcdefghÿ", 3)])
def test_variants_equal_brute_force(spark, letters, seed):
    words = noisy(seed, 60, letters)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n int")
    assert told(spelling_variants(df)) == plainly(words)


def test_hot_halves_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "INDEX_LETTERS", 60)
    monkeypatch.setattr(spelling, "SEARCHED", 7)
    words = noisy(4, 25, "abc", 40) + [w for w in ("stemab", "stemac", "stembc", "stem" + "x" * 9)
                                       for _ in range(6)]
    words += [f"stem{a}{b}" for a in "abcdefghij" for b in "abcdefghij" for _ in range(5)]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert told(spelling_variants(df)) == plainly(words)


def test_index_finds_every_pair_once():
    rng = random.Random(8)
    for longest in (2, 3, 6, 7, 12):
        words = sorted({"".join(rng.choices("abc", k=longest - rng.randint(0, 1)))
                        for _ in range(120)} - {""})
        held = np.array(sorted(rng.sample(range(len(words)), len(words) * 2 // 3)))
        got = Counter()
        for left in (True, False):
            got.update(zip(*(x.tolist() for x in near_words(words, held, longest, left)),
                           strict=True))
        want = Counter((i, j) for i in range(len(words)) for j in held.tolist()
                       if one_error(words[i], words[j])
                       and max(len(words[i]), len(words[j])) == longest)
        assert got == want


def test_intervals_of_both_sides_agree():
    words = ["abcab", "abab", "bcabc", "cabab", "ab"]
    lengths = np.array([len(w) for w in words])
    codes = np.zeros((5, 5), dtype=np.int32)
    for i, w in enumerate(words):
        codes[i, :len(w)] = [" abc".index(c) for c in w]
    index, text = BidirectionalIndex(codes, lengths, 4), "".join(f"|{w}" for w in words)
    for half in ("ab", "ca", "bc", "aa", "ba"):
        for left, pattern in ((True, f"|{half}"), (False, f"{half}|")):
            order = [*half[::-1], "|"] if left else [*half, "|"]
            low, size = index.half(np.array([["|abc".index(c) for c in order]]), left)
            assert size[0] == (text + text[:2]).count(pattern)
            side = index.right if left else index.left
            read = (text[::-1] if left else text) * 2
            asked = pattern[::-1] if left else pattern
            for start in side.starts[low[0]:low[0] + size[0]]:
                assert read[start:start + 3] == asked


def test_odd_words(spark):
    long = "ab" * 3_000
    words = ([None, "", "short"] * 6 + ["longer"] * 4 + ["alonewd"] * 5
             + [long] * 30 + [long[:-1]] * 6 + [long[:2_000] + "x" + long[2_000:]] * 5)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = told(spelling_variants(df))
    assert got == sorted([("alonewd", 5, 0, None, None, "alonewd"),
                          (long, 30, 2, None, None, long),
                          (long[:-1], 6, 1, long, 30, long),
                          (long[:2_000] + "x" + long[2_000:], 5, 1, long, 30, long)])
    assert told(spelling_variants(df.limit(0))) == []
    with pytest.raises(ValueError):
        spelling_variants(df, times=1)


def test_words_of_bodies(bodies):
    rows = message_words(bodies("Ünï côdé-x 漢字don't ÀB×cĀd", None, "", "aB aB",
                                rowids=[1, 2, 3, None])).collect()
    assert [(r["rowid"], r["word"]) for r in rows] == [
        (1, "Ünï"), (1, "côdé"), (1, "x"), (1, "don"), (1, "t"), (1, "Àb×c"), (1, "d"),
        (None, "ab"), (None, "ab")]


def test_query_equals_brute_force_on_the_small_tables(spark):
    words = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            words.append(run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run)
    got = told(entry.queries()["op13_spelling_variants"](spark, SMALL))
    assert got == plainly(words) and any(r[3] for r in got)
