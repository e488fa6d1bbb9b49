"""Repeated rows, rows without an id, bodies past a step's size and empty tables, job by job."""

import math

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from daybook.llm import language as lg
from daybook.llm import rule_ensemble as re_
from daybook.llm.contamination import contained_items, free_of_items
from daybook.llm.packing import pack_messages
from daybook.llm.repeated_passages import remove_repeated_passages
from daybook.llm.repetition import repetition_verdicts
from daybook.llm.secret_scan import fit_secret_network, labelled_findings, scan_secrets
from daybook.llm.suffix_tree import fit_suffix_tree, score_messages
from daybook.llm.texts import STEP_CHARS
from daybook.llm.token_counts import count_message_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: One id three times (twice the same body), two rows without an id, a body longer than a step.
LONG = "Lorem ipsum dolor sit amet. " * 40_000
BODIES = ("some words stand here", "some words stand here", "other words, here", "without an id",
          "without an id", LONG, "", None)
IDS = (1, 1, 1, None, None, 2, 3, 4)


def rated(messages):
    return re_.rate_messages(messages, re_.RuleEnsemble(0.1, (
        (re_.Rule((("word_length", True, 3.0),)), 1.0),)))


def told(messages):
    model = lg.fit_language(["some english words", "quelques mots ici"] * 20, ["en", "fr"] * 20)
    return lg.identify_languages(messages, model)


def scored(messages):
    learned = messages.withColumn("learned", F.lit(True))
    return score_messages(learned, fit_suffix_tree(learned)).drop("learned")


def scanned(messages):
    return scan_secrets(messages, fit_secret_network(labelled_findings(messages)))


JOBS = {"op1": rated, "op2": told, "op4": scored,
        "op6": lambda m: count_message_tokens(m, PATH),
        "op7": lambda m: pack_messages(m, PATH).groupBy("rowid").agg(F.sum("length").alias("n")),
        "op8": remove_repeated_passages, "op9": repetition_verdicts, "op10": scanned}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_every_row_is_answered_whatever_its_id_and_length(bodies, name):
    assert len(LONG) > STEP_CHARS
    rows = JOBS[name](bodies(*BODIES, rowids=IDS)).collect()
    if name == "op7":
        assert {r["rowid"] for r in rows} == set(IDS)
        sizes = {r["rowid"]: r["n"] for r in rows}
        assert sizes[3] == sizes[4] == 1 and sizes[2] > 100_000
        return
    assert sorted(map(str, (r["rowid"] for r in rows))) == sorted(map(str, IDS))
    answers = {}
    for r in rows:
        answers.setdefault(r["rowid"], []).append(tuple(v for k, v in r.asDict().items()
                                                        if k != "rowid"))
    assert answers[None][0] == answers[None][1] and answers[3] == answers[4]
    assert any(answers[1].count(a) >= 2 for a in answers[1])
    assert all(not isinstance(v, float) or math.isfinite(v) for a in answers.values() for x in a
               for v in x)
    assert JOBS[name](bodies()).collect() == []


def test_items_in_repeated_and_nameless_and_long_bodies(spark, bodies):
    items = spark.createDataFrame(
        [(1, "lorem ipsum dolor sit amet"), (2, "lorem ipsum dolor sit amet"), (3, None), (4, " "),
         (None, "some words stand here")], "item_id long, text string")
    messages = bodies(*BODIES, rowids=IDS)
    got = sorted(map(str, ((r["rowid"], r["item_id"]) for r in
                           contained_items(messages, items).collect())))
    assert got == sorted(map(str, [(2, 1), (2, 2), (1, None), (1, None)]))
    left = free_of_items(messages, items)
    assert sorted(map(str, (r["rowid"] for r in left.collect()))) == sorted(
        map(str, (1, None, None, 3, 4)))
    assert contained_items(bodies(), items).collect() == []
    assert contained_items(messages, items.limit(0)).collect() == []
