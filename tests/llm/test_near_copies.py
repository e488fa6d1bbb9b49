import numpy as np
import xxhash

from daybook.llm import near_copies as nc
from tests.llm.conftest import ODD


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(ids, fps, radius=2):
    group = dict(enumerate(range(len(ids))))
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = {k: new if g == old else g for k, g in group.items()}
    return [min(ids[k] for k in group if group[k] == group[i]) for i in range(len(ids))]


def cluster(seed, n):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 62, 4, dtype=np.uint64)
    out = centre[rng.integers(0, 4, n)]
    for _ in range(4):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(out)


def test_fingerprint_equals_the_plain_rule():
    for text in [*ODD, "A b C d e f", "one two"]:
        assert nc.fingerprint(text or "") == plain_fingerprint(text)


def test_leaf_search_finds_every_pair():
    fps = cluster(1, 700)
    i, j = nc.search_leaf(fps, fps[:300], 2)
    want = np.argwhere(np.bitwise_count(fps[:300, None] ^ fps[None]) <= 2)
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(x) for x in want.tolist()]


def test_links_equal_brute_force_when_nodes_are_cut(spark):
    fps = cluster(2, 600)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {tuple(r) for r in nc.linked_fingerprints(table, 2, leaf=16).collect()}
    signed = fps.view(np.int64)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2)
    assert got == {tuple(sorted((int(signed[a]), int(signed[b])))) for a, b in near if a < b}
    assert len(got) > 50


def test_groups_of_messages(bodies):
    texts = [*ODD, "see you at the gate at nine tomorrow morning then",
             "See you at the gate at nine tomorrow morning then"]
    ids = [9, 3, 8, 4, 5, 6, 1, 11, 10]
    rows = nc.near_copies(bodies(*texts, rowids=ids)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    want = dict(zip(ids, zip([f"{f:016x}" for f in fps], plain_groups(ids, fps))))
    assert {r["rowid"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    rows = nc.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == (
        {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)})


def test_repeated_rows_and_an_empty_table(bodies, spark):
    rows = nc.near_copies(bodies("a b", "a b", rowids=[2, 2])).collect()
    assert [r["component_id"] for r in rows] == [2, 2]
    assert nc.near_copies(bodies().limit(0)).count() == 0
