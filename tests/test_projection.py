"""The projected table: touched buckets only, emptied ones too, laid out anew when crowded."""

import tempfile
import uuid
from pathlib import Path

from daybook.operators import projection as pj

SCHEMA = "person_id string, day string, pointer string"


def lines(spark, *persons):
    return spark.createDataFrame([(p, f"2024-01-{d:02d}", f"{p} {d}") for p, n in persons
                                  for d in range(1, n + 1)], SCHEMA)


def people(spark, *persons):
    return spark.createDataFrame([(p,) for p in persons], "person_id string")


def projected(spark, path, schema, persons=None, upto=(1 << 63) - 1):
    got = {}
    for r in pj.read_projection(spark, path, schema, persons, upto).collect():
        got[r["person_id"]] = got.get(r["person_id"], 0) + 1
    return got


def test_touched_buckets_are_replaced_and_emptied_ones_read_empty(spark):
    path = tempfile.mkdtemp(prefix="daybook-test-") + uuid.uuid4().hex
    everyone = [(f"p{i}", 1 + i % 4) for i in range(40)]
    first = lines(spark, *everyone).union(lines(spark, (None, 2)))
    schema = first.schema
    assert projected(spark, path, schema) == {}
    pj.write_projection(first, first, path, 0, bucket_rows=5)
    want = dict(everyone)
    assert projected(spark, path, schema) == want
    alone = {r["bucket"]: r["rows"] for r in pj.current_buckets(spark, path).collect()}
    assert len(alone) == 20 and sum(alone.values()) == sum(want.values())

    # p3 loses its last line, p5 one of two; the lines of others are not even given.
    touched = people(spark, "p3", "p5", None)
    for _again in range(2):
        pj.write_projection(lines(spark, ("p5", 1), ("p8", 9)), touched, path, 1, bucket_rows=5)
    del want["p3"]
    want["p5"] = 1
    assert projected(spark, path, schema) == want
    assert projected(spark, path, schema, people(spark, "p5", "p3", "p6")) == {"p5": 1, "p6": 3}
    assert projected(spark, path, schema, upto=0) == dict(everyone)
    versions = [r["version"] for r in pj.current_buckets(spark, path).collect()]
    assert sorted(versions)[-2:] == [1, 1] and versions.count(1) == 2

    # A whole bucket that becomes empty.
    bucket = pj.current_buckets(spark, path).filter("rows > 0").first()["bucket"]
    in_it = [p for p in want if spark.range(1).selectExpr(
        f"pmod(xxhash64('{p}'), 20) AS b").first()["b"] == bucket]
    pj.write_projection(lines(spark), people(spark, *in_it), path, 2, bucket_rows=5)
    assert projected(spark, path, schema) == {p: n for p, n in want.items() if p not in in_it}


def test_a_crowded_table_is_laid_out_anew(spark):
    path = tempfile.mkdtemp(prefix="daybook-test-") + uuid.uuid4().hex
    first = lines(spark, *[(f"p{i}", 1) for i in range(20)])
    pj.write_projection(first, first, path, 0, bucket_rows=10)
    more = lines(spark, *[(f"p{i}", 5) for i in range(20)])
    pj.write_projection(more, more, path, 1, bucket_rows=10)
    assert pj.current_buckets(spark, path).count() == 2          # measured before the run
    pj.write_projection(more, people(spark, "p1"), path, 2, bucket_rows=10)
    buckets = pj.current_buckets(spark, path).collect()
    assert len(buckets) == 10 and {r["layout"] for r in buckets} == {2}
    assert projected(spark, path, first.schema) == {f"p{i}": 5 for i in range(20)}


def test_reading_some_persons_prunes_folders(spark):
    path = tempfile.mkdtemp(prefix="daybook-test-") + uuid.uuid4().hex
    first = lines(spark, *[(f"p{i}", 3) for i in range(60)])
    pj.write_projection(first, first, path, 0, bucket_rows=3)
    df = pj.read_projection(spark, path, first.schema, people(spark, "p7"))
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert df.count() == 3


def files_of(path):
    """Data files in each folder under ``path``."""
    found = {}
    for f in Path(path).rglob("*.parquet"):
        found[f.parent] = found.get(f.parent, 0) + 1
    return found


def test_a_bucket_is_one_file_whatever_the_number_of_tasks(spark):
    path = tempfile.mkdtemp(prefix="daybook-test-") + uuid.uuid4().hex
    rows = lines(spark, *[(f"p{i}", 6) for i in range(60)]).repartition(16)
    for version in (0, 1):
        pj.write_projection(rows, rows, path, version, bucket_rows=40)
    files = files_of(f"{path}/data")
    assert len(files) > 10 and set(files.values()) == {1}
    assert projected(spark, path, rows.schema) == {f"p{i}": 6 for i in range(60)}
