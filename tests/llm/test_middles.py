import hashlib
import random
import re

import pyarrow as pa
import pytest

from daybook.llm import middles
from daybook.llm.middles import fill_in_middle, rebuilt, restore_messages
from tests.llm.conftest import ODD


def plainly(rowid, text, seed=7, rate=100, spm=50):
    """The rule for one body, said step by step."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if rowid is None else rowid}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def mixed(n, seed):
    rng = random.Random(seed)
    bits = ["\n", "\n", "\n\n", "\r\n", "a", "line", " ", "é", "漢", "😀", "\x00", "<", "<S", ">", "P>",
            " ", "\x85", "<M", "S", "<P>"]
    weights = [6] * (len(bits) - 1) + [1]
    return ["".join(rng.choices(bits, weights, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 50), (100, 0)])
def test_samples_equal_the_plain_rule(bodies, rate, spm):
    texts = [*ODD, "\n", "no end", "end\n", "<S", "<P>", "x<M>y", *mixed(300, rate + spm)]
    rows = restore_messages(fill_in_middle(bodies(*texts), 7, rate, spm)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"],
                r["output"]) == plainly(r["rowid"], texts[r["rowid"]], 7, rate, spm)
        assert r["restored"] == (texts[r["rowid"]] or "")


def test_every_cut_of_a_body_is_found_again():
    text = "one <\n<S\n\ntwo\nthree <"
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    for a in range(len(units) + 1):
        for b in range(a, len(units) + 1):
            p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
            outputs = [f"<P>{p}<S>{s}<M>{m}", text, f"<S>{s}<P>{p}<M>{m}"]
            assert rebuilt(pa.array(outputs), pa.array(["psm", "plain", "spm"])).to_pylist() == [
                text] * 3


def test_long_bodies_null_and_repeated_ids(bodies, monkeypatch):
    monkeypatch.setattr(middles, "STEP_BYTES", 1_000)
    long = "a long line\n" * 200_000 + "漢" * 1_500_000
    texts = [long, "a\nb\nc", "a\nb\nc", "d\ne", None, long[:900], "", "z\n" * 3_000]
    ids = [1, None, None, 3, 3, 4, 5, 6]
    rows = restore_messages(fill_in_middle(bodies(*texts, rowids=ids))).collect()
    got = sorted((str(r["rowid"]), r["n"], r["form"], r["output"]) for r in rows)
    want = [(i, plainly(i, t)) for i, t in zip(ids, texts, strict=True)]
    assert got == sorted((str(i), w[0], w[1], w[4]) for i, w in want)
    assert sorted(r["restored"] for r in rows) == sorted(t or "" for t in texts)


def test_an_empty_table_and_clashing_columns(spark, bodies):
    empty = restore_messages(fill_in_middle(bodies()))
    assert empty.columns == ["rowid", "n", "form", "prefix_chars", "middle_chars", "output",
                             "restored"]
    assert empty.collect() == []
    clash = spark.createDataFrame([("k1", "a\nb", 5, "n")], "rowid string, text string, n int, "
                                                            "form string")
    row = fill_in_middle(clash).first()
    assert row["rowid"] == "k1" and row["output"] == plainly("k1", "a\nb")[4]
    again = restore_messages(restore_messages(fill_in_middle(clash)))
    assert again.columns.count("restored") == 1
