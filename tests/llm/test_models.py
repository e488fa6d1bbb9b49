import math
import random
import string

import numpy as np
from pyspark.sql import functions as F

from daybook.llm import language as lg
from daybook.llm import rule_ensemble as re_
from daybook.llm import secret_scan as sc
from daybook.llm.texts import crc_fold
from tests.llm.conftest import ODD

SMALL = "/root/testdata/sf0.01"


def small(spark, *more):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs.select(F.col("doc_id").alias("rowid"), "text", *more)


def test_quality_on_rows_not_learned_from(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select(
        F.col("doc_id").alias("rowid"), F.col("quality").alias("keep"))
    model = re_.fit_rule_ensemble(small(spark), labels.filter(crc_fold("rowid", 3) != 1))
    assert model.rules
    rows = (re_.rate_messages(small(spark), model).join(labels, "rowid")
            .filter(crc_fold("rowid", 3) == 1).collect())
    assert np.mean([r["predicted"] == r["keep"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_compiled_rules_equal_their_plain_reading(bodies):
    model = re_.RuleEnsemble(0.5, (
        (re_.Rule((("word_length", True, 3.0), ("mark_share", False, 0.0))), -2.0),
        (re_.Rule((("distinct_word_share", True, 0.5),)), 1.25)))
    texts = [*ODD, "a# b# c#", "hey hey hey hey"]
    x = re_.measure([t or "" for t in texts])
    table = np.stack([x[n] for n in re_.STATISTICS], axis=1)
    z = 0.5 + sum(w * r.holds(table) for r, w in model.rules)
    got = {r["rowid"]: r["score"] for r in re_.rate_messages(bodies(*texts), model).collect()}
    assert all(math.isclose(got[i], 1 / (1 + math.exp(-v))) for i, v in enumerate(z))


def test_no_verdicts_or_one_class_give_a_flat_score(bodies, spark):
    none = spark.createDataFrame([], "rowid long, keep int")
    rows = re_.rate_messages(bodies("a", None), re_.fit_rule_ensemble(bodies("a"), none)).collect()
    assert [r["score"] for r in rows] == [0.5, 0.5]
    one = spark.createDataFrame([(0, 1), (0, 1), (1, None)], "rowid long, keep int")
    model = re_.fit_rule_ensemble(bodies("a", "b"), one)
    assert not model.rules and model.intercept > 0
    assert re_.rate_messages(bodies().limit(0), model).count() == 0


def test_language_on_rows_not_learned_from(spark):
    rows = small(spark, F.col("lang").alias("language"))
    model = lg.fit_message_language(rows.filter(crc_fold("rowid", 3) != 1))
    told = lg.identify_languages(rows, model).join(rows, "rowid")
    told = told.filter(crc_fold("rowid", 3) == 1).collect()
    assert np.mean([r["lang_pred"] == r["language"] for r in told]) > 0.98
    assert not any(r["rejected"] for r in told)


def test_language_of_odd_bodies(bodies):
    model = lg.fit_language(["see you at the gate"] * 20 + ["bis morgen am tor"] * 20,
                            ["en"] * 20 + ["de"] * 20)
    texts = [*ODD, "12:30 !", "see the gate", "morgen am tor"]
    rows = {r["rowid"]: r for r in lg.identify_languages(bodies(*texts), model).collect()}
    for i in (0, 1, 2, 7):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and rows[i]["rejected"]
    assert rows[8]["lang_pred"] == "en" and rows[9]["lang_pred"] == "de"
    nothing = lg.identify_languages(bodies("a"), None).collect()[0]
    assert nothing["lang_pred"] == "und" and nothing["rejected"]
    assert lg.fit_message_language(bodies("a").withColumn("language", F.lit(None))) is None


def test_base_rules_of_secrets():
    text = ('passwd: short, Secret = "abcdefgh" x token=secret=abcdefgh1 AKIA12345678ABCD '
            "AKIA1 " + "0f" * 16 + " " + "0f" * 15 + " ſecret=abcdefgh")
    kinds = [(k, text[a:b]) for a, b, k in sc.base_spans(text)]
    assert kinds == [("assign", 'Secret = "abcdefgh'), ("assign", "token=secret=abcdefgh1"),
                     ("access", "AKIA12345678ABCD"), ("hex", "0f" * 16)]


def test_network_finds_secrets_it_has_not_seen_and_spares_plain_values():
    net = sc.fit_network(*sc.made_findings(600, seed=1))
    rows, label = sc.made_findings(300, seed=2)
    found = net.accepts(rows)
    assert found[label == 1].mean() > 0.9 and found[label == 0].mean() < 0.05


def test_scan_adds_to_the_base_and_takes_nothing_away(bodies):
    texts = [*ODD, "token = abcdef0123456789", "my key kJ8s9dKq2LmX7vBn4RtY6wZp is new"]
    messages = bodies(*texts)
    net = sc.fit_secret_network(sc.labelled_findings(messages))
    rows = {r["rowid"]: r for r in sc.scan_secrets(messages, net).collect()}
    assert rows[7]["spans"] == "assign:0:24" and rows[7]["n_assign"] == 1
    assert rows[8]["spans"] == "learned:7:31" and rows[8]["n_assign"] == 0
    assert rows[0]["spans"] == "" and rows[0]["base_sha256"] == rows[8]["base_sha256"]
    assert sc.scan_secrets(messages.limit(0), net).count() == 0


def test_threshold_follows_recall_under_one_half():
    rows, label = sc.made_findings(300, seed=2)
    secret = [r for r, s in zip(rows, label) if s]
    rng = np.random.default_rng(4)
    # A third of what looks like a secret is one: no finding can score far over a third.
    label = (rng.random(3 * len(secret)) < 0.33).astype(float)
    net = sc.fit_network(secret * 3, label)
    assert 0 < min(net.thresholds) < 0.5 and 0.2 < net.precision < 0.5
    held = np.random.default_rng(3).random(len(label)) < 0.2
    found = net.accepts([r for r, h in zip(secret * 3, held) if h])
    assert found[label[held] == 1].mean() >= 0.95


def test_candidates_are_all_runs_but_plain_words():
    text = ("Ordinary words, CAPITALS and Capitalised; abcdefg1 12345678 555-0716 "
            "kJsdKqLm averyveryverylongword ABCDEFGHIJKLMNOPQRSTU short1 a-b-c-d-e")
    assert [text[a:b] for a, b in sc.candidates(text)] == [
        "abcdefg1", "12345678", "555-0716", "kJsdKqLm", "averyveryverylongword",
        "ABCDEFGHIJKLMNOPQRSTU", "a-b-c-d-e"]


def test_a_candidate_reaching_over_a_base_span_is_judged(spark):
    net = sc.fit_secret_network(sc.labelled_findings(small(spark)))
    long = "Zq" + "0f" * 16 + "Xk9LmW2"
    text = f"note {long} and token={'ab12' * 6} end"
    (spans,) = sc.found_spans([text], net)
    assert [(k, text[a:b]) for a, b, k in spans] == [
        ("learned", long), ("hex", "0f" * 16), ("assign", "token=" + "ab12" * 6)]


def test_planted_secrets_that_the_base_misses_are_found_on_the_tables(spark):
    rng = random.Random(41)
    pick = lambda pool, k: "".join(rng.choice(pool) for _ in range(k))
    shapes = {"mixed": lambda: pick(string.ascii_letters + string.digits, 24),
              "letters": lambda: pick(string.ascii_letters, 26),
              "digits": lambda: pick(string.digits, 30),
              "marked": lambda: pick(string.ascii_letters + string.digits + "+/", 30) + "==",
              "lower": lambda: pick(string.ascii_lowercase + string.digits, 28)}
    clean = [(r["rowid"], r["text"]) for r in small(spark).filter("text IS NOT NULL").collect()]
    made = {}
    for i, (rowid, text) in enumerate(clean[:600]):
        shape = sorted(shapes)[i % len(shapes)]
        at = text.find(" ", rng.randrange(len(text) + 1)) + 1
        made[rowid] = (shape, value := shapes[shape](), f"{text[:at]}{value} {text[at:]}")
    rows = spark.createDataFrame([(i, made[i][2] if i in made else t) for i, t in clean],
                                 "rowid long, text string")
    findings = sc.labelled_findings(small(spark))
    judged = findings.filter("secret = 0").count()
    assert judged > 20                               # on the tables as they are
    net = sc.fit_secret_network(findings)
    hit, wrong = {k: [] for k in shapes}, 0
    for r in sc.scan_secrets(rows, net).collect():
        learned = [s.split(":")[1:] for s in r["spans"].split(",") if s.startswith("learned")]
        text = made[r["rowid"]][2] if r["rowid"] in made else dict(clean)[r["rowid"]]
        values = [text[int(a):int(b)] for a, b in learned]
        if r["rowid"] in made:
            shape, value, _ = made[r["rowid"]]
            hit[shape].append(value in values)
            values = [v for v in values if v != value]
        wrong += len(values)
    assert all(sum(h) >= 0.9 * len(h) for h in hit.values()), {k: sum(h) for k, h in hit.items()}
    assert wrong <= 2


def test_the_sample_does_not_depend_on_the_layout(spark):
    findings = sc.labelled_findings(small(spark)).cache()
    nets = [sc.fit_secret_network(findings.repartition(n), most=15) for n in (1, 7)]
    assert all(np.array_equal(a, b) for a, b in ((nets[0].out, nets[1].out),
                                                  (nets[0].embed, nets[1].embed)))
    assert sc.fit_secret_network(findings.limit(0)).precision > 0.9


def test_findings_beyond_one_group_are_learned_from(spark):
    findings = sc.labelled_findings(small(spark)).cache()
    place = F.xxhash64("rowid", "start", "window")
    few = [findings.filter(F.col("secret") == k).orderBy(place).limit(15) for k in (0, 1)]
    assert findings.count() > 30
    every, lowest = (sc.fit_secret_network(f, most=15)
                     for f in (findings, few[0].unionByName(few[1])))
    assert not np.allclose(every.out, lowest.out)
    rows, groups = sc.training_rows(findings, most=15)
    own = findings.select("window", "secret")
    assert groups > 2 and own.exceptAll(rows.select("window", "secret")).count() == 0
