import re

import numpy as np

from daybook.llm.components import _star, components
from daybook.session import durable


def brute(links):
    head = {}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i
    for a, b in links:
        if a != b:
            low, high = sorted((top(head.setdefault(a, a)), top(head.setdefault(b, b))))
            head[high] = low
    return {i: top(i) for i in head}


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    for links in ([], [(1, 1)], [(5, 3), (3, 5)], [(i, i + 1) for i in range(200)],
                  [(0, i) for i in range(1, 300)],
                  [tuple(map(int, p)) for p in rng.integers(0, 2000, (1000, 2))]):
        rows = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert {r["node"]: r["component"] for r in rows} == brute(links)
        assert len(rows) == len({r["node"] for r in rows})


def test_a_round_shuffles_three_times(spark, capsys):
    links = durable(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))
    after = _star(_star(links, large=True), large=False).distinct()
    after.collect()
    after.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    made = [x for x in plan.splitlines() if re.search(r"Exchange hashpart", x) and "Reused" not in x]
    assert "isFinalPlan=true" in plan and len(made) == 3
