"""Column jobs on hand-made values."""

import random

from pyspark.sql import functions as F

from daybook.functions import redaction as R
from daybook.functions import text as X
from daybook.functions import times as M
from daybook.operators import landing as la


def column(spark, values, job, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", job.alias("o")).orderBy("i").collect()]


def test_handles(spark):
    given = ["+1 (555) 010-0000", "555-0000002", " Me@Example.com ", " ", "---", "+", "22395",
             "(555) 0000003", "1 555 000 1234", "123456789012345", "12345678901234", None]
    want = ["+15550100000", "+15550000002", "me@example.com", None, None, None, "22395",
            "+15550000003", "+15550001234", "123456789012345", "+112345678901234", None]
    once = column(spark, given, X.normalise_handle(F.col("v")))
    assert once == want
    assert column(spark, once, X.normalise_handle(F.col("v"))) == want


def test_slugs(spark):
    given = ["José (cell)", "ﬁne Ⅷ", "a" * 59 + "--b", "éte", "", None, "x/y:z"]
    assert column(spark, given, X.slug_label(F.col("v"))) == [
        "jose-cell", "fine-viii", "a" * 59, "ete", "label", "label", "x-y-z"]
    odd = column(spark, ["日本", "中国"], X.slug_label(F.col("v")))
    assert odd[0] != odd[1] and all(o.startswith("label-") for o in odd)


def test_redaction_hits_and_leaves(spark):
    cases = {
        "Your verification code is 483920": "Your verification code is [redacted]",
        "483920 is your Apple ID verification code": "[redacted] is your Apple ID verification code",
        "G-483920 is it": "G-[redacted] is it",
        "Reply with 4821 to confirm": "Reply with [redacted] to confirm",
        "card 4111 1111 1111 1111 ok": "card [redacted] ok",
        "acct 12345678901234567": "acct [redacted]",
        "the password is hunter2": "the password is [redacted]",
        "combination to the shed is 1122": "combination to the shed is [redacted]",
        "gate pin: 1234": "gate pin: [redacted]",
        "card ending in 4821": "card ending in [redacted]",
        "last 4 digits are 4821": "last 4 digits are [redacted]",
        "****2026": "****[redacted]",
        "two 4111111111111111 4111111111111111": "two [redacted] [redacted]",
    }
    kept = ["your zip code is 90210", "error code: 1234", "the lease ends in 2026",
            "my number is 2125550143", "+8613812345678", "http://x.y/?id=1234567890123456",
            "1Z999AA10123456784", "pin 2026 budget", "the password is on the fridge",
            "123456789012345678901", "Send 1500 to confirm the booking",
            "the password is [redacted]", "", None]
    given = [*cases, *kept]
    once = column(spark, given, R.redact("v"))
    assert once == [*cases.values(), *kept]
    assert column(spark, once, R.redact("v")) == once


def test_mixed_epoch_units(spark):
    got = column(spark, [727000000123456789, 727000000, 99999999999, None],
                 M.instant(F.col("v")).cast("string"), "bigint")
    assert got == ["2024-01-15 08:26:40.123456", "2024-01-15 08:26:40", None, None]


def test_keys_round_trip(spark):
    given = ["+1555|day|2024-01-02", "a|b|day|2024-01-02", "a|day|2024-02-30", "a|week|2024-01-02"]
    assert column(spark, given, X.key_ident(F.col("v"))) == ["+1555", "a|b", None, None]


def test_masks_and_scrub(spark):
    assert column(spark, ["+12025550123", "jo@example.com"], X.mask_shape(F.col("v"))) == [
        "+<11 digits>", "<local 2>@<domain 11>"]
    assert column(spark, ["call +12025550123 or a@b.co — now\tok"], X.scrub_line(F.col("v"))) == [
        "call [number] or [address]; now ok"]
    assert column(spark, ["one two three four"], X.cap_line(F.col("v"), 12)) == ["one two…"]


def test_summary_rules(spark):
    topic = F.lit("Texts (3): can we move to four")
    job = la.summary_problem(F.col("v"), topic)
    assert column(spark, ["Moved it to four.", "can we move", "Texts (3)", " ", "a\nb", "a — b",
                          "x" * 401, "see (→ y", None], job) == [
        None, "restates the line", "restates the line", "empty", "line break", "em dash",
        "too long", "link opening", "not text"]


def secretive(seed, n):
    """Random texts of what the rules are made of, sentence ends, quotes and long fillers."""
    rng = random.Random(seed)
    bits = ["verification", "security", "one time", "code", "pass code", "PIN", "pins", "token",
            "your", "acme", "is", "is your", ":", "=", "are", "for", "to", "the", "door", "gate",
            "wi-fi", "combination", "password", "enter", "reply with", "verify", "log in", "G-",
            "4821", "48291", "2026", "4111111111111111", "4111 1111 1111 1111", "hunter2", "ends in",
            "ending with", "last four digits", "last 4", "****", "•••", "[redacted]", "zip", "error",
            "٤٨٢١٩", "paſs", "compass", "shopping", "don't", '"a b. c d"', "'x! y? z'", '"', "'",
            ".", "!", "?", ";", ",", "-", "\n", "  ", "\t\n ", " " * 90, " ", "\x00", "é", "漢", "😀",
            "", ""]
    fill = ["word ", "and so on. ", "what now? ", "x" * 700 + " ", "a " * 70, "lorem ipsum dolor " * 40,
            "no ends here, " * 60, "\n" * 30, "y" * 50 + ". "]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += [rng.choice(bits) + rng.choice(["", " ", " ", " "])
                      for _ in range(rng.randint(1, 12))]
            parts += [rng.choice(fill) for _ in range(rng.randint(0, 3))]
        out.append("".join(parts))
    return out


def test_windows_give_what_whole_texts_give(spark):
    quoted = 'the password is "' + "q. " * 12 + 'e" 4821 and so. ' * 3
    far = "your verification" + " " * 5_000 + "code is" + "\n" * 9 + "482193"
    texts = [*secretive(1, 2_500), quoted, far, "x. " * 400 + far, far + " y. " * 400 + quoted,
             "4821. " * 500, "pin " * 500, "", None, "password is " + "a" * 100_000 + "1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    whole = F.expr(R._bound(R._plain("v"), "b", R._settled("b")))
    rows = df.select("i", R.redaction_spans("v").alias("cut"), whole.alias("whole")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["cut"] == r["whole"], texts[r["i"]]
    assert sum(bool(r["cut"]) for r in rows) > 300


def test_windows_leave_most_of_a_text_out(spark):
    text = "An ordinary sentence of some words. " * 500
    text += "The door code is 4821 today. " + text + "No end here and no secret " * 300
    size = F.expr(f"aggregate({R._windows(R._marked('v'))}, 0, (n, w) -> n + w.size)")
    assert 0 < column(spark, [text], size, "string")[0] < 400
