import math

import numpy as np
import pytest

from daybook.llm import close_vectors as cv
from daybook.llm.close_vectors import close_vectors, tables_for

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n int"


def plainly(rows, least=0.93):
    """All pairs: per row its links and the least id that they reach."""
    def units(v):
        return np.array(v, dtype=np.float64) / math.sqrt(sum(float(x) ** 2 for x in v))

    def usable(r):
        v = r[1]
        return (r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v)
                and any(v))

    n = len(rows)
    near, x = [[] for _ in rows], {i: units(r[1]) for i, r in enumerate(rows) if usable(r)}
    for i in x:
        for j in x:
            if (i < j and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j])
                    and float(x[i] @ x[j]) >= least):
                near[i].append(j)
                near[j].append(i)
    low, seen = {}, set()
    for i in range(n):
        if i not in seen:
            part, todo = [], [i]
            seen.add(i)
            while todo:
                k = todo.pop()
                part.append(k)
                for j in near[k]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            named = [rows[k][0] for k in part if rows[k][0] is not None]
            low |= dict.fromkeys(part, min(named) if named else None)
    return sorted(((rows[i][0], len(near[i]), low[i], rows[i][0] == low[i]) for i in range(n)),
                  key=repr)


def found(df):
    out = close_vectors(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def planted(seed, n=300, width=16, cosines=(0.931, 0.94, 0.96, 0.99, 0.92, 0.9)):
    """Random vectors, each third with a chain of neighbours at the given cosines."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        v = rng.standard_normal(width)
        label = int(rng.integers(0, 3))
        rows.append((v, label))
        for c in cosines[:i % 3 * 3]:
            u = v / np.linalg.norm(v)
            w = rng.standard_normal(width)
            w -= (w @ u) * u
            v = c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w)
            rows.append((v * rng.uniform(0.01, 50), label))
    order = rng.permutation(len(rows))
    return [(k, [float(np.float32(x)) for x in rows[i][0]], rows[i][1], "x", 3)
            for k, i in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(cv, "MEAN_BUCKET", 16)      # several bits, so that recall is at stake
    rows = planted(seed)
    assert found(spark.createDataFrame(rows, SCHEMA)) == plainly(rows)


def test_hot_buckets_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(cv, "BLOCK", 40)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(8)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.standard_normal(8) * 0.3], 1, "", 0)
            for i in range(400)]
    rows += [(1000 + i, rows[7][1], 1, "", 0) for i in range(150)]      # copies of one vector
    assert found(spark.createDataFrame(rows, SCHEMA)) == plainly(rows)


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, a, 1, "", 0), (1, a, 1, "", 0), (2, a, None, "", 0), (3, None, 1, "", 0),
            (4, [], 1, "", 0), (5, [0.0] * 3, 1, "", 0), (6, [1.0, None, 0.0], 1, "", 0),
            (7, [nan, 1.0, 0.0], 1, "", 0), (8, [inf, 1.0, 0.0], 1, "", 0), (9, a, 2, "", 0),
            (None, [2.0, 0.0, 0.0], 1, "", 0), (None, b, 5, "", 0), (None, b, 5, "", 0),
            (10, b, 1, "", 0), (10, [3e38, 3e38, 0.0], 1, "", 0), (11, [1e-38, 1e-38, 0.0], 1, "", 0),
            (12, a + a, 1, "", 0), (13, [1.0, 0.0], 1, "", 0)]
    got, want = found(spark.createDataFrame(rows, SCHEMA)), plainly(rows)
    assert got == want
    assert (None, 1, None, True) in got and (None, 2, 1, False) in got
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_ids_of_another_type_and_doubles(spark):
    rows = [("b", [1.0, 1.0], "x"), ("a", [1.0, 1.01], "x"), ("c", [1.0, -1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    assert found(df) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_given_tables_lose_no_link(spark):
    base = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(base)
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in df.collect()]
    assert found(df) == plainly(rows)


def test_tables_follow_the_bound():
    for rows in (0, 1, 600, 10 ** 5, 10 ** 8):
        bits, tables = tables_for(rows)
        agree = 1 - math.acos(0.93) / math.pi
        assert (1 - agree ** bits) ** tables <= 1e-4 and 1 <= bits <= 30
    assert tables_for(10 ** 5, least=1.0)[1] == 1
