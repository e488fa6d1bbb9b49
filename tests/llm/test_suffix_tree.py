import math
from collections import Counter

import numpy as np

from daybook.llm import suffix_tree as st
from tests.llm.conftest import ODD

TEXTS = [*ODD, "See you at the gate", "see you at the door at nine", "the gate, the door",
         "x" * 5000 + " end", *(f"call me at {i % 7} then at {i % 5}" for i in range(60))]


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_base_counts_equal_the_plain_rule(bodies):
    learned = [i % 3 != 0 for i in range(len(TEXTS))]
    from pyspark.sql import functions as F
    messages = bodies(*TEXTS).withColumn("learned", F.col("rowid") % 3 != 0)
    tree = st.fit_suffix_tree(messages.filter("learned"))
    rows = {r["rowid"]: r for r in st.score_messages(messages, tree).collect()}
    count = Counter(t for x, ok in zip(TEXTS, learned) if ok for t in tokens(x))
    total, kinds = sum(count.values()), len(count)
    for i, text in enumerate(TEXTS):
        mine = tokens(text)
        base = sum(math.log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in mine)
        assert rows[i]["n_tokens"] == len(mine) and rows[i]["train_tokens"] == total
        assert rows[i]["n_known"] == sum(count[t] > 0 for t in mine)
        assert math.isclose(rows[i]["base_score"], base, rel_tol=1e-9)
        assert math.isclose(rows[i]["score"], tree.score([st.normal(text)])[0], rel_tol=1e-9)
        assert rows[i]["score"] < 0


def plain_levels(texts, alphabet):
    windows = Counter(st.packed_windows(st.symbols(texts, alphabet)[0]).tolist())
    levels = []
    for k in range(st.DEPTH + 1):
        short = Counter()
        for code, n in windows.items():
            short[code & ((1 << st.BITS * (k + 1)) - 1)] += n
        rows = np.array([(c >> st.BITS, c & 127, n) for c, n in sorted(short.items())])
        levels.append((rows[:, 0], rows[:, 1], rows[:, 2]))
    return levels


def test_distributions_sum_to_one_and_states_follow_the_longest_suffix():
    texts = [st.normal(t) for t in TEXTS]
    alphabet = np.array(sorted({ord(c) for t in texts for c in t} - {32})[:100], dtype=np.uint32)
    tree = st.build_tree(plain_levels(texts, alphabet), alphabet)
    p = 10.0 ** tree.logp.astype(np.float64)
    p[:, st.OTHER] *= 0x110000
    assert np.allclose(p.sum(axis=1), 1.0, atol=1e-4)
    assert len(tree.step) > 20
    # Walking a text in one go or in stretches gives the same score.
    flat, begin = st.symbols(texts[-2:-1], alphabet)
    state, total = 0, 0.0
    for at in range(begin[0] - st.DEPTH, len(flat)):
        if at >= begin[0]:
            total += tree.logp[state, flat[at]]
        state = tree.step[state, flat[at]]
    assert math.isclose(total, tree.score(texts[-2:-1])[0], rel_tol=1e-6)
    long = "ab " * 3000
    one = tree.score([long])[0]
    st_stretch, st.STRETCH = st.STRETCH, 10 ** 6
    try:
        assert math.isclose(one, tree.score([long])[0], rel_tol=1e-9)
    finally:
        st.STRETCH = st_stretch


def test_longer_contexts_help_where_text_repeats(bodies):
    from pyspark.sql import functions as F
    texts = [f"see you at the gate number {i} tomorrow" for i in range(80)]
    messages = bodies(*texts).withColumn("learned", F.col("rowid") % 4 != 0)
    tree = st.fit_suffix_tree(messages.filter("learned"))
    flat = st.SuffixTree(tree.alphabet, np.zeros_like(tree.step[:1]), tree.logp[:1])
    clean = [st.normal(t) for t in texts[::4]]
    assert tree.score(clean).sum() > 0.6 * flat.score(clean).sum()
    assert (tree.score(clean) > flat.score(clean)).all()


def test_nothing_to_learn_from_and_empty_tables(bodies):
    from pyspark.sql import functions as F
    messages = bodies("a b", None, rowids=[1, 1]).withColumn("learned", F.lit(False))
    tree = st.fit_suffix_tree(messages.filter("learned"))
    rows = st.score_messages(messages, tree).collect()
    assert [r["n_known"] for r in rows] == [0, 0] and rows[0]["train_tokens"] == 0
    assert st.score_messages(messages.limit(0), tree).count() == 0


def test_families_learn_what_one_automaton_does_and_no_character_shares_a_symbol(
        bodies, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(st, "GROUP_BYTES", 900)
    monkeypatch.setattr(st, "BUCKET_TEXT", 700)
    kana, han, greek = (["".join(chr(a + (7 * i + j * j) % n) for j in range(12))
                         for i in range(40)] for a, n in ((0x3041, 80), (0x4E00, 400), (0x3B1, 24)))
    texts = [*TEXTS, *kana, *han, *greek, *(f"{a} {b}" for a, b in zip(kana, greek))]
    assert len(set("".join(t or "" for t in texts))) > 300
    messages = bodies(*texts).withColumn("learned", F.col("rowid") % 3 != 0)
    tree = st.fit_suffix_tree(messages.filter("learned"))
    for scored in (st.score_messages(messages), st.score_messages(messages, tree)):
        rows = {r["rowid"]: r["score"] for r in scored.collect()}
        want = tree.score([st.normal(t) for t in texts])
        assert np.allclose([rows[i] for i in range(len(texts))], want, rtol=1e-6)
    # Rare scripts have contexts: their texts are likelier than the same characters turned round.
    for script in (kana, han, greek):
        assert tree.score(script).sum() > tree.score([t[::-1] for t in script]).sum() + 40


def test_contexts_are_kept_by_occurrence_and_not_by_share(bodies):
    rare = ["zq jx vk wz"] * 3
    small = st.fit_suffix_tree(bodies(*rare, *(["see you at the gate"] * 10)))
    large = st.fit_suffix_tree(bodies(*rare, *(["see you at the gate"] * 60_000)))
    clean = [st.normal(rare[0])]
    assert len(large.step) >= len(small.step)
    assert large.score(clean)[0] > -10


def test_characters_beyond_the_most_frequent_ones_are_told_apart(bodies):
    common = "".join(chr(0x100 + i) for i in range(120))
    tree = st.fit_suffix_tree(bodies(*[common] * 20, *["漢字仮名"] * 3))
    met, turned = tree.score(["漢字仮名", "名仮字漢"])
    assert met > turned + 1
