from pyspark.sql import functions as F

import corpus_pipeline as cp
from daybook.llm.secret_scan import base_spans
from daybook.session import durable
from tests.llm.conftest import ODD
from tests.llm.test_contamination import brute
from tests.llm.test_similar_texts import brute as near_groups

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 1) for i, t, g in rows], SCHEMA)


def table(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_in_order_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet")
             .select("item_id", "text").collect()]
    kept = {}
    for name, stage in cp.STAGES[:4]:
        docs = durable(stage(spark, docs, SMALL))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept["language"]) == set(texts)          # every text has letters: none is rejected
    mine = list(kept["near_duplicates"])
    assert sorted(mine) == sorted(set(near_groups(texts).values())) and len(mine) < len(texts)
    hit = {mine[i] for i, *_ in brute([texts[i] for i in mine], items)}
    assert set(kept["decontamination"]) == set(mine) - hit and hit
    for i, r in kept["secrets"].items():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert bool(base_spans(texts[i])) or r["text"] == texts[i]
    packed = cp.packing(spark, docs, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept["secrets"])


def test_run_returns_the_last_table(spark):
    rows = cp.run(spark, SMALL)
    assert "sequence_id" in rows.columns and rows.count() > 100


def test_language_stage_drops_what_has_no_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(50, "12 34 !", "en"), (51, "two", None)]
    left = table(cp.language(spark, docs_of(spark, rows), SMALL))
    assert [i for i, _ in left] == [3, 4, 5, 51, 6]


def test_near_duplicate_stage_keeps_one_of_each(spark):
    rows = [(5, "same words here", "en"), (2, "same words here", "en"), (2, "same words here", "en"),
            (7, None, "en"), (8, "", "en"), (None, "no id", "en"), (9, "something else now", "en")]
    left = table(cp.near_duplicates(spark, docs_of(spark, rows), SMALL))
    assert [i for i, _ in left] == [2, 7, 9, None]


def test_near_duplicate_stage_compares_rows_without_an_id_or_with_one_id_in_common(spark):
    words = [f"w{i}" for i in range(60)]
    base, near = " ".join(words), " ".join([*words[:59], "x"])
    rows = [(4, base, "en"), (None, base, "en"), (None, near, "en"),       # two copies without an id
            (None, "no id", "en"), (None, "no id", "de"), (None, None, "en"), (None, "", "en"),
            (6, "one text of id six", "en"), (6, "another of the same id", "en"),
            (6, near, "en"), (7, "one text of id six", "en")]
    left = table(cp.near_duplicates(spark, docs_of(spark, rows), SMALL))
    assert [(i, t or "") for i, t in left] == sorted(
        [(4, base), (6, "one text of id six"), (6, "another of the same id"), (None, "no id"),
         (None, "")], key=str)


def test_other_stages_on_odd_rows(spark):
    secret = "use token = abcdef0123456789 and password: hunter2hunter2, fine"
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(9, secret, "en"), (9, secret, "en"),
                                                        (None, secret, None)]
    docs = docs_of(spark, rows)
    assert cp.decontamination(spark, docs, SMALL).count() == len(rows)
    out = cp.secrets(spark, docs, SMALL)
    assert out.columns == docs.columns
    text = out.filter(F.col("source") == "s").filter("doc_id = 9").first()["text"]
    assert text == "use [redacted] and [redacted], fine"
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert cp.packing(spark, docs, SMALL).filter("doc_id = 9").count() == 2
