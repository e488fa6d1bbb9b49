"""Resolution, names, ranking and set joins against brute force on small fixtures."""

import random

from pyspark.sql import functions as F

from daybook.operators import resolve as rs
from daybook.operators.audit import arrival_disorder
from daybook.operators.ranking import number_rows


def test_suffix_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    def number():
        return "+" + "".join(rnd.choice("12") for _ in range(rnd.randrange(7, 11)))
    asked = sorted({number() for _ in range(300)})
    cards = sorted({(number(), f"p{i % 40}") for i in range(300)})
    got = rs.suffix_matches(spark.createDataFrame([(a,) for a in asked], "ident string"),
                            spark.createDataFrame(cards, "ident string, person_id string"))
    want, exact = {}, {c for c, _ in cards}
    for a in asked:
        hits = {p for c, p in cards if a not in exact
                and (a[1:].endswith(c[1:]) or c[1:].endswith(a[1:]))}
        if hits:
            want[a] = (min(hits), max(hits))
    assert {r.ident: (r.lo, r.hi) for r in got.collect()} == want and want


def test_names_equal_brute_force(spark):
    rnd = random.Random(6)
    words = ["ann", "anna", "bob", "bo", "cara", "x"]
    def name():
        return " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))
    people = [(f"p{i}", name().title()) for i in range(60)]
    asked = [(i, name()) for i in range(60)]

    def tier(q, n):
        q, n = q.split(), n.lower().split()
        if sorted(q) == sorted(n):
            return 3
        if all(w in n for w in q):
            return 2
        return int(all(len(w) >= 2 and any(h.startswith(w) for h in n) for w in q))
    want = set()
    for i, q in asked:
        best = max(tier(q, n) for _, n in people)
        if best:
            want |= {(i, p, best) for p, n in people if tier(q, n) == best}
    got = rs.match_people(spark.createDataFrame(asked, "query_id int, query string"),
                          spark.createDataFrame(people, "person_id string, name string"))
    assert {(r.query_id, r.person_id, r.tier) for r in got.collect()} == want


def test_number_rows_is_one_total_order(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("a"), F.col("id"))
    got = number_rows(df, [F.col("a").desc(), F.col("id").asc()], "n", partitions=7).collect()
    want = sorted(((i % 3, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert [(r.a, r.id) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(1, 5001))


def test_arrival_disorder_any_bucket(spark):
    rnd = random.Random(7)
    data = [(i, rnd.randrange(50) + i // 2) for i in range(400)]
    prev = sum(b[1] < a[1] for a, b in zip(data, data[1:], strict=False))
    top = sum(v < max(x for _, x in data[:i]) for i, (_, v) in enumerate(data) if i)
    for bucket in (2, 7, 1000):
        r = arrival_disorder(spark.createDataFrame(data, "rowid long, at long"), bucket).collect()[0]
        assert (r.rows, r.before_previous, r.before_maximum) == (400, prev, top)
