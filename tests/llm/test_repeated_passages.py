import hashlib
import random
from collections import Counter

from daybook.llm import repeated_passages as rp
from tests.llm.conftest import ODD


def brute(texts, window=rp.WINDOW):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - window + 1):
            if seen[d[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["gate", "nine", "tomorrow", "née", "über", "call", "me", "at", "the", "door"]
    talk = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(k))
    passages = [talk(40) for _ in range(4)]
    texts = [*ODD, "z" * 900, "ab" * 300, "z" * 199, "z" * 200]
    for _ in range(n):
        parts = [talk(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 60)
            parts += [p[a:a + rng.randint(150, 400)], talk(rng.randint(0, 30))]
        texts.append("".join(parts))
    texts += texts[-3:]
    return texts


def check(rows, texts, ids):
    want = dict(zip(ids, brute(texts)))
    assert {r["rowid"]: tuple(r)[1:] for r in rows} == want
    return sum(v[1] > 0 for v in want.values())


def test_removal_equals_brute_force(bodies):
    texts = corpus(1)
    assert check(rp.remove_repeated_passages(bodies(*texts)).collect(), texts,
                 range(len(texts))) > 20


def test_many_groups_buckets_and_steps_agree(bodies, monkeypatch):
    monkeypatch.setattr(rp, "GROUP_BYTES", 6_000)
    monkeypatch.setattr(rp, "BUCKET_NAMES", 40)
    texts = corpus(2)
    check(rp.remove_repeated_passages(bodies(*texts)).collect(), texts, range(len(texts)))


def test_levels_inside_one_group():
    import pyarrow as pa
    texts = corpus(3)
    work = rp.Passages(3)
    group = pa.table({"grp": [5] * len(texts), "rowid": list(range(len(texts))), "text": texts})

    def told(asked):
        rows = asked.to_pylist()
        keys = sorted({(r["level"], r["bucket"]) for r in rows})
        return [rp.answer(pa.Table.from_pylist(
            [r for r in rows if (r["level"], r["bucket"]) == k], schema=asked.schema))
            for k in keys]

    answers = told(work.ask(rp.PLACES, group))
    for level in (rp.RUNS, rp.WINDOWS):
        answers += told(work.ask(level, group, pa.concat_tables(answers)))
    rows = work.remove(group, pa.concat_tables(answers)).to_pylist()
    assert [tuple(r.values())[1:] for r in rows] == brute(texts)


def test_nothing_repeated_and_empty(bodies):
    assert rp.remove_repeated_passages(bodies().limit(0)).count() == 0
    rows = rp.remove_repeated_passages(bodies("a" * 100, None)).collect()
    assert [(r["n_bytes"], r["n_removed"]) for r in sorted(rows)] == [(100, 0), (0, 0)]


def test_steps_do_not_show(monkeypatch):
    texts = [(t or "").encode() for t in corpus(4)]
    fields = ("first", "last", "at", "gram", "long")
    whole = rp.Group(texts)
    for step in (1, 7, 200, 1 << 10):
        monkeypatch.setattr(rp, "STEP", step)
        cut = rp.Group(texts)
        assert all((getattr(cut, f) == getattr(whole, f)).all() for f in fields)


def test_hashing_holds_little_more_than_its_result():
    import tracemalloc
    texts = [random.Random(i).randbytes(4_000) for i in range(500)]
    tracemalloc.start()
    work = rp.Group(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(work.first) and peak < 30 * sum(map(len, texts))
