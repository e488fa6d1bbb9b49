"""The follow-up of a yes, the checked matches and the versioned identifier records."""

import tempfile
import uuid

from pyspark.sql import functions as F

from daybook.operators import settle as st

RECORD = "ident string, state string, hold_reason string, match_person string, match_confirmed string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_every_branch_of_a_yes(spark):
    numbers = {n: f"+155500000{i:02d}" for i, n in enumerate(
        ("erin", "taken", "no", "no_attach", "new", "owner", "dismissed", "refused_row"))}
    steps = spark.createDataFrame(
        [(numbers["erin"], "known", "p1", "accept", None)] * 2
        + [(numbers["taken"], "attach", "p2", "accept", None),
           (numbers["no"], "known", "p3", "accept", None),
           (numbers["no_attach"], "attach", "p3", "accept", None),
           (numbers["new"], "new", None, "accept", None),
           (numbers["owner"], "known", "p9", "accept", None),
           (numbers["dismissed"], "known", "p1", "dismiss", None),
           (numbers["refused_row"], "known", "p1", "accept", "needs a name")],
        "ident string, section string, target string, action string, refusal string")
    asked = spark.createDataFrame([(n, None) for n in numbers.values()], "ident string, name string")
    card_ids = spark.createDataFrame([(numbers["taken"], "p7"), ("+15557654321", "p1")],
                                     "ident string, person_id string")
    cards = spark.createDataFrame([(f"p{i}", f"N{i}") for i in range(10)],
                                  "person_id string, name string")
    refused = spark.createDataFrame([(numbers["no"],), (numbers["no_attach"],)], "ident string")
    held = spark.createDataFrame([(numbers[n], f"{n}|{d}") for n in numbers for d in (1, 2, 3)],
                                 "ident string, key string")
    stamped, queue = (spark.createDataFrame([(k,)], "key string") for k in ("erin|1", "erin|2"))
    owners = spark.createDataFrame([("p9",)], "person_id string")
    updates, released = st.settle_accepts(steps, asked, card_ids, cards, refused, held, stamped,
                                          queue, owners)
    assert rows(updates, "ident", "outcome", "new_state", "hold_reason", "person_id", "match_route",
                "queued", "already", "owner_dropped") == sorted([
        (numbers["erin"], "done", "accepted", None, "p1", "exact", 1, 2, 0),
        (numbers["taken"], "cannot_attach", "held", "cannot_attach", "p2", None, 0, 0, 0),
        (numbers["no"], "left_pending", "pending", None, "p3", None, 0, 0, 0),
        (numbers["no_attach"], "left_pending", "attach_pending", None, "p3", None, 0, 0, 0),
        (numbers["new"], "second_yes", "attach_pending", None, None, None, 0, 0, 0),
        (numbers["owner"], "done", "accepted", None, "p9", "exact", 0, 0, 3)], key=repr)
    assert rows(released, "ident", "key", "person_id") == [(numbers["erin"], "erin|3", "p1")]


def test_checks_are_numbered_apart(spark):
    checks = spark.createDataFrame(
        [("b", "p1", 1, 1), ("a", "p1", 2, 0), ("c", "p2", 5, 4), ("d", "gone", 0, 2)],
        "ident string, person_id string, filed long, waiting long")
    cards = spark.createDataFrame([("p1", "Zoe"), ("p2", "ann")], "person_id string, name string")
    assert rows(st.check_rank(checks, cards), "label", "ident", "days") == [
        ("m1", "c", 9), ("m2", "d", 2), ("m3", "a", 2), ("m4", "b", 2)]


def test_records_keep_versions_and_the_newest_is_read(spark):
    path = tempfile.mkdtemp(prefix="daybook-test-") + uuid.uuid4().hex
    first = spark.createDataFrame([("a", "accepted", None, None, None),
                                   ("b", "accepted", "x", None, None)], RECORD)
    assert st.newest_records(spark, path, first.schema).count() == 0
    st.save_records(first, path, 0)
    checks = spark.createDataFrame([("a", "p1"), ("n", "p2")], "ident string, person_id string")
    st.save_records(st.changed_records(first, st.confirmed(checks)), path, 1)
    wrong = st.pinned(checks.filter("ident = 'a'")).drop("proposal_id")
    for _again in range(2):
        st.save_records(st.changed_records(st.newest_records(spark, path, first.schema, 1), wrong),
                        path, 2)
    assert rows(st.newest_records(spark, path, first.schema), *first.columns) == [
        ("a", "dismissed", "wrong_match", "p1", "p1"), ("b", "accepted", "x", None, None),
        ("n", None, None, None, "p2")]
    assert rows(st.newest_records(spark, path, first.schema, 0), "ident", "state") == [
        ("a", "accepted"), ("b", "accepted")]


def test_rows_to_number_are_made_once(spark):
    from daybook.operators.ranking import number_rows
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(500).mapInPandas(count, "id long")
    numbered = number_rows(rows, [F.col("id").desc()], "no").collect()
    assert sorted((r["no"], r["id"]) for r in numbered) == [(i + 1, 499 - i) for i in range(500)]
    assert made.value == 500
