from daybook.llm import contamination as ct
from tests.llm.conftest import ODD

PASSAGE = "the quick brown fox jumps over the lazy dog and runs away from seven angry bees"


def brute(texts, items, shingle=5, least=0.8):
    out = set()
    for i, text in enumerate(texts):
        words = ct.plain_words(text or "")
        for item, body in items:
            want = ct.plain_words(body or "")
            if not want:
                continue
            k = min(shingle, len(want))
            mine = {tuple(words[j:j + k]) for j in range(len(words) - k + 1)}
            its = {tuple(want[j:j + k]) for j in range(len(want) - k + 1)}
            if len(mine & its) >= least * len(its):
                out.add((i, item, len(mine & its), len(its)))
    return out


def corpus():
    words = PASSAGE.split()
    long = " ".join(f"w{i % 977}" for i in range(9000))
    edited = " ".join(["slow" if i == 0 else w for i, w in enumerate(words)])
    return [*ODD, PASSAGE, long[:30000] + " " + PASSAGE.upper().replace(" ", ", ") + " " + long,
            edited, " ".join(words[:9]), "angry bees", "nothing here at all"]


ITEMS = [(1, PASSAGE), (2, PASSAGE), (3, "angry bees"), (4, None), (5, "  "), (6, "w1 w2 w3 w4 w5"),
         (7, "not in any of the texts at all, not even once")]


def test_found_items_equal_brute_force(bodies, spark):
    texts = corpus()
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, "
                                                                 "rowid int")
    got = ct.contained_items(bodies(*texts), items)
    assert {tuple(r)[:4] for r in got.collect()} == brute(texts, ITEMS)
    assert got.columns == ["rowid", "item_id", "shared", "item_shingles", "containment"]


def test_several_passes_find_the_same(bodies, spark, monkeypatch):
    monkeypatch.setattr(ct, "ITEMS_PER_PASS", 3)
    texts = corpus()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ct.contained_items(bodies(*texts), items)
    assert {tuple(r)[:4] for r in got.collect()} == brute(texts, ITEMS)


def test_random_items_lose_nothing(bodies, spark):
    import random
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 400))) for _ in range(60)]
    items = [(n, " ".join((t := rng.choice(texts).split())[(s := rng.randint(0, max(0, len(t) - 9))):
                                                         s + rng.randint(3, 60)]))
             for n in range(60)]
    got = ct.contained_items(bodies(*texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r)[:4] for r in got.collect()} == brute(texts, items)


def test_empty_tables(bodies, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ct.contained_items(bodies("a"), none).count() == 0
    assert ct.contained_items(bodies().limit(0), none).count() == 0
