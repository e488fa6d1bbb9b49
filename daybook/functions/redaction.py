"""Secret-shaped spans in a body, found and replaced inside the JVM.

Most of a text can't be part of a hit.  One cheap pass finds the anchors (four digits in a row, the
beginnings of the secret nouns), a window is cut around each, and the patterns run on the windows
alone.  A window ends where no hit can reach across: at the end of a sentence that no open quote
spans, or after more words than any pattern takes.

Every pattern has three parts: what leads up to the secret (group 1), the secret (group 2)
and, where a match must also read on, what follows (group 3).  ``regexp_replace`` brackets
the secret with two private-use characters, so the pieces of a ``split`` on them give exact
offsets; overlaps are then settled leftmost, longest, rule order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.text import WHITESPACE

# --- fixed values: the redaction rules --------------------------------------------------
REDACTION = "[redacted]"
RULES = ("otp_code", "long_digit_run", "password_or_pin", "card_tail")

LEFT = r"(?<![+0-9A-Za-z])"
RIGHT = r"(?![0-9A-Za-z])"
NEAR = r"[^0-9\n.!?;]{0,24}?"
NEAR_WIDE = r"[^0-9\n.!?;]{0,32}?"
NOT_URL = r"(?<![=/&?#._~-])"
NOT_A_SECRET_CODE = (
    r"(?<!zip )(?<!zip-)(?<!area )(?<!area-)(?<!dress )(?<!error )(?<!promo )"
    r"(?<!postal )(?<!country )(?<!source )(?<!barcode )(?<!bar )(?<!qr )(?<!morse )"
    r"(?<!coupon )(?<!referral )(?<!discount )(?<!routing )(?<!tax )(?<!sort )"
    r"(?<!swift )(?<!status )(?<!color )(?<!colour )(?<!cpt )(?<!icd )(?<!ada )"
    r"(?<!procedure )(?<!diagnosis )(?<!billing )(?<!npi )(?<!exit )")
OTP_QUALIFIER = (
    r"(?:verification|verify|verifying|security|one[\s-]?time|single[\s-]?use|login|log[\s-]?in|"
    r"sign[\s-]?in|signin|access|confirmation|confirm|authentication|authorisation|"
    r"authorization|auth|activation|activate|2fa|mfa|otp|temporary|temp|secret|unlock|recovery|"
    r"reset|registration|enrollment|enrolment)")
OTP_NOUN = r"(?:code|passcode|pass\s?code|pin|password|token)"
OTP_DIGITS = r"\d{4,10}"
OTP_VERB = r"(?:use|using|enter|reply\s+with|text\s+back|text)"
OTP_PURPOSE = (
    r"(?:verify|confirm|activate|authenticate|log\s?in|sign\s?in|continue|"
    r"complete\s+(?:your\s+)?(?:sign[\s-]?in|log[\s-]?in|registration|verification|setup))")
SECRET_NOUN = (
    r"(?:passwords?|passwd|pass\s?words?|passcodes?|pass\s?codes?|passphrases?|pins?|"
    r"pin\s?codes?|combos?|combinations?)")
PLACE_NOUN = (
    r"(?:door|doors|gate|garage|lock|lockbox|key\s?box|alarm|safe|keypad|entry|building|gym|"
    r"pool|shed|storage|unit|locker|vault|wi[\s-]?fi|wifi|network|router|hotspot|guest)")
ASSIGN = r"\s*(?:is|are|=|:)\s*"
SECRET_VALUE = (
    r'"[^"\n]{2,40}"' r"|'[^'\n]{2,40}'"
    r"|(?=[A-Za-z0-9._!@#$%^&*+/-]{0,39}\d)[A-Za-z0-9._!@#$%^&*+/-]{2,39}[A-Za-z0-9]")
NOT_A_YEAR = r"(?!19\d\d|20\d\d)"
CARD_GROUPS = r"[3-6]\d{3}(?<sep>[ -])\d{4}\k<sep>\d{4}(?:\k<sep>\d{1,4})?"

#: (rule, before the secret, the secret, after the secret), in tie-break order.
PATTERNS: tuple[tuple[str, str, str, str], ...] = (
    ("otp_code", OTP_QUALIFIER + r"[\s-]+" + NOT_A_SECRET_CODE + OTP_NOUN + r"\b" + NEAR + LEFT,
     OTP_DIGITS, RIGHT),
    ("otp_code", r"\byour\s+(?:[A-Za-z][A-Za-z0-9'’]{0,14}\s+){0,2}" + NOT_A_SECRET_CODE
     + OTP_NOUN + r"\b" + NEAR + LEFT, OTP_DIGITS, RIGHT),
    ("otp_code", LEFT, OTP_DIGITS, RIGHT + r"\s+is\s+(?:your|the|my)\b" + NEAR_WIDE
     + NOT_A_SECRET_CODE + OTP_NOUN + r"\b"),
    ("otp_code", r"\bG-", r"\d{4,8}", RIGHT),
    ("otp_code", OTP_VERB + r"\s+(?:the\s+)?(?:code\s+)?" + LEFT, OTP_DIGITS,
     RIGHT + NEAR + r"\bto\s+" + OTP_PURPOSE + r"\b"),
    ("long_digit_run", LEFT + NOT_URL, r"\d{13,19}", RIGHT),
    ("long_digit_run", LEFT + NOT_URL, CARD_GROUPS, RIGHT),
    ("password_or_pin", r"\b" + SECRET_NOUN + r"\b" + ASSIGN, SECRET_VALUE, RIGHT),
    ("password_or_pin", r"\b(?:code|combo|combination)\s+(?:for|to)\s+"
     r"(?:the\s+|our\s+|my\s+|your\s+)?(?:[A-Za-z][A-Za-z0-9'’-]{0,14}\s+){0,3}?" + ASSIGN,
     SECRET_VALUE, RIGHT),
    ("password_or_pin", r"\b" + PLACE_NOUN + r"\s+(?:code|password|passcode|pin|combo|"
     r"combination)\b" + ASSIGN, SECRET_VALUE, RIGHT),
    ("card_tail", r"\bend(?:s|ed|ing)?\s+(?:in|with)\s*[#:]?\s*" + LEFT + NOT_A_YEAR,
     r"\d{4}", RIGHT),
    ("card_tail", r"\blast\s+(?:four|4)\s*(?:digits?)?\s*(?:are|is|:|=)?\s*" + LEFT
     + NOT_A_YEAR, r"\d{4}", RIGHT),
    ("card_tail", r"(?:[*x•·●#]{3,})\s*-?\s*" + LEFT, r"\d{4}", RIGHT),
)
# --- end of fixed values ----------------------------------------------------------------

OPEN, CLOSE = "\ue000", "\ue001"
#: Every hit holds four digits in a row or the beginning of a secret noun.
#: One class of first characters comes before anything else, so other places cost one test.
_ANCHOR = r"(?U)[\dpPcC](?:(?<=\d)\d{3,}|(?<=\b[pPcC])(?iu:ass|in|omb|ode))"
#: Characters looked at on either side of an anchor, and the words among them that are more than
#: any hit spans (at most 48 runs of white space, of any length); with fewer, all is looked at.
_REACH, _WORDS = 600, 64
#: The end of a sentence with no quote in the 42 characters before it: of all patterns only a quoted
#: value, 40 characters long at most, spans such a place.  So many are always left next to an anchor.
_SENTENCE_END = r"[.!?;](?<![\"'].{0,42})\s"
_NEXT_END, _LAST_END = rf"(?s)^.{{43,}}?{_SENTENCE_END}", rf"(?s)^.{{43,}}{_SENTENCE_END}"
_NUMERIC_GATE = r"(?U)\d{4}"
_NOUN_GATE = r"(?iU)pass|pin|comb|code"
#: Per pattern, what its text must hold, as a test on the lower-cased copy ``f`` (words) or by a
#: cheap expression (shapes).  Only patterns that pass are run, so ordinary prose costs a few
#: substring searches.
_OTP_NOUNS = ("code", "pass", "pin", "token")
_SECRET_NOUNS = ("pass", "pin", "combo", "combination")
_NEEDS: tuple[tuple[tuple[str, ...] | str, ...], ...] = (
    (_OTP_NOUNS,), (("your",), _OTP_NOUNS), (_OTP_NOUNS, ("your", "the", "my")), (("g-",),),
    (("use", "using", "enter", "reply", "text"), ("verify", "confirm", "activate", "authenticate",
                                                  "log", "sign", "continue", "complete")),
    (r"(?U)\d{13}",), (r"(?U)\d{4}[ -]\d{4}",), (_SECRET_NOUNS, ("is", "are", "=", ":")),
    (("code", "combo", "combination"), ("for", "to"), ("is", "are", "=", ":")),
    (("code", "pass", "pin", "combo", "combination"), ("is", "are", "=", ":")),
    (("end",), ("in", "with")), (("last",), ("four", "4")), (r"(?iu)[*x•·●#]{3}",),
)

SPAN_TYPE = "array<struct<start:int,neg_len:int,rule_no:int>>"


def _text(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(marked: str, rule_no: int) -> str:
    """Offsets of the bracketed pieces of ``marked`` in the unbracketed text."""
    return f"""aggregate(split({marked}, {_text(f"[{OPEN}{CLOSE}]")}, -1),
      named_struct('at', 0, 'n', 0, 'spans', cast(array() AS {SPAN_TYPE})),
      (a, p) -> named_struct('at', a.at + length(p), 'n', a.n + 1, 'spans',
        CASE WHEN a.n % 2 = 1 THEN concat(a.spans, array(named_struct('start', a.at,
          'neg_len', -length(p), 'rule_no', {rule_no}))) ELSE a.spans END),
      a -> a.spans)"""


def _needed(body: str, position: int) -> str:
    """The cheap test for one pattern; ``f`` is the folded copy of ``body``."""
    tests = []
    for need in _NEEDS[position]:
        if isinstance(need, str):
            tests.append(f"{body} RLIKE {_text(need)}")
        else:
            tests.append("(" + " OR ".join(f"contains(f, {_text(w)})" for w in need) + ")")
    return " AND ".join(tests)


def _rule_spans(body: str, wordy: bool) -> str:
    found = []
    for position, (rule, before, secret, after) in enumerate(PATTERNS):
        if (rule == "password_or_pin") == wordy:
            last = 4 if "<sep>" in secret else 3
            marked = (f"regexp_replace({body}, {_text(f'(?iU)({before})({secret})({after})')}, "
                      f"{_text(f'$1{OPEN}$2{CLOSE}${last}')})")
            found.append(f"CASE WHEN {_needed(body, position)} THEN "
                         f"{_spans(marked, RULES.index(rule))} ELSE cast(array() AS {SPAN_TYPE}) END")
    # Folded the way the patterns ignore case: long s and dotless i count as s and i.
    return _bound(f"translate(lower({body}), 'ſı', 'si')", "f", "concat(" + ", ".join(found) + ")")


def _settled(body: str) -> str:
    """Winning spans of a sentinel-free body as SQL: leftmost, longest, rule order."""
    kept = _spans(f"replace({body}, {_text(REDACTION)}, {_text(OPEN + REDACTION + CLOSE)})", 0)
    return f"""transform(array(concat(
        CASE WHEN {body} RLIKE {_text(_NUMERIC_GATE)} THEN {_rule_spans(body, False)}
          ELSE cast(array() AS {SPAN_TYPE}) END,
        CASE WHEN {body} RLIKE {_text(_NOUN_GATE)} THEN {_rule_spans(body, True)}
          ELSE cast(array() AS {SPAN_TYPE}) END)), found -> CASE WHEN size(found) = 0 THEN found
      ELSE aggregate(array_sort(filter(found, s -> s.neg_len < 0 AND NOT exists({kept}, k ->
          s.start < k.start - k.neg_len AND k.start < s.start - s.neg_len))),
        named_struct('end', -1, 'hits', cast(array() AS {SPAN_TYPE})),
        (a, s) -> CASE WHEN s.start < a.end THEN a ELSE
          named_struct('end', s.start - s.neg_len, 'hits', concat(a.hits, array(s))) END,
        a -> a.hits) END)[0]"""


def _reach(near: str, kept: str) -> str:
    """How much of a piece of text ``p`` belongs to the window of the anchor at one end of it.

    ``near`` is the part next to the anchor that is looked at, ``kept`` the length of ``t``, which
    is that part, up to a sentence end (that of all of it, or 0, if there is none).
    """
    chosen = f"""CASE WHEN k BETWEEN 1 AND length(t) - 1 THEN k
      WHEN length(p) <= {_REACH} OR regexp_count(t, '\\\\S\\\\s') < {_WORDS} THEN length(p)
      ELSE {_REACH} END"""
    return _bound(near, "t", _bound(kept, "k", chosen))


def _marked(body: str) -> str:
    """The sentinel-free body with its anchors bracketed."""
    return f"regexp_replace({body}, {_text(_ANCHOR)}, {_text(f'{OPEN}$0{CLOSE}')})"


def _windows(marked: str) -> str:
    """Disjoint (start, size) windows of the unbracketed text that hold every anchor and every hit.

    Split at its anchors, the text is pieces and anchors in turn.  A piece is cut where the reach of
    the anchor before it ends and where that of the anchor behind it begins, if they don't meet.
    """
    onward = _reach(f"left(p, {_REACH})", f"length(regexp_extract(t, {_text(_NEXT_END)}, 0))")
    back = _reach(f"right(p, {_REACH})", f"length(regexp_replace(t, {_text(_LAST_END)}, ''))")
    windows = "array<struct<start:int,size:int>>"
    return f"""aggregate(transform(split({marked}, {_text(f"[{OPEN}{CLOSE}]")}, -1), (p, i) ->
        CASE WHEN i % 2 = 1 THEN named_struct('n', length(p), 'onward', -1, 'back', 0)
          ELSE named_struct('n', length(p), 'onward', CASE WHEN i > 0 THEN {onward} ELSE 0 END,
            'back', {back}) END),
      named_struct('at', 0, 'start', 0, 'open', false, 'cut', cast(array() AS {windows})),
      (w, p) -> named_struct('at', w.at + p.n,
        'start', CASE WHEN p.onward < 0 OR p.onward + p.back >= p.n AND w.open THEN w.start
          ELSE w.at + p.n - p.back END,
        'open', p.onward < 0 OR p.onward + p.back >= p.n AND w.open,
        'cut', CASE WHEN w.open AND p.onward >= 0 AND p.onward + p.back < p.n
          THEN concat(w.cut, array(named_struct('start', w.start,
            'size', w.at + p.onward - w.start))) ELSE w.cut END),
      w -> CASE WHEN w.open THEN concat(w.cut, array(named_struct('start', w.start,
        'size', w.at - w.start))) ELSE w.cut END)"""


def _found(body: str) -> str:
    """Winning spans of a sentinel-free body: those of its windows, moved to their places."""
    inside = _bound(f"substring({body}, win.start + 1, win.size)", "x", _settled("x"))
    moved = f"""flatten(transform({_windows('m')}, win -> transform({inside}, hit ->
      named_struct('start', hit.start + win.start, 'neg_len', hit.neg_len,
        'rule_no', hit.rule_no))))"""
    return _bound(_marked(body), "m", f"CASE WHEN contains(m, {_text(OPEN)}) THEN {moved} "
                                      f"ELSE cast(array() AS {SPAN_TYPE}) END")


def _gated(body: str, work: str, rest: str) -> str:
    """``work`` for a body with an anchor; others cost one compiled test."""
    return f"CASE WHEN {body} RLIKE {_text(_ANCHOR)} THEN {work} ELSE {rest} END"


def _bound(value: str, name: str, work: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``work``."""
    return f"transform(array({value}), {name} -> {work})[0]"


def _plain(body: str) -> str:
    """The body without the two brackets; the copy is made only where there are any."""
    return (f"CASE WHEN contains({body}, {_text(OPEN)}) OR contains({body}, {_text(CLOSE)}) "
            f"THEN translate({body}, {_text(OPEN + CLOSE)}, {_text(chr(0xe002) * 2)}) "
            f"ELSE {body} END")


def redaction_spans(column: str) -> Column:
    """The winning, non-overlapping spans of a body: array of (start, neg_len, rule_no)."""
    work = _bound(_plain(column), "b", _found("b"))
    return F.expr(_gated(column, work, f"cast(array() AS {SPAN_TYPE})"))


def rule_name(rule_no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RULES]), rule_no + 1)


def redact_sql(body: str) -> str:
    rebuilt = f"""CASE WHEN size(hits) = 0 THEN {body} ELSE
      aggregate(hits, named_struct('at', 0, 'out', cast('' AS string)),
        (a, s) -> named_struct('at', s.start - s.neg_len, 'out', concat(a.out,
          substring({body}, a.at + 1, s.start - a.at), {_text(REDACTION)})),
        a -> concat(a.out, substring({body}, a.at + 1, length({body})))) END"""
    return _gated(body, _bound(_bound(_plain(body), "b", _found("b")), "hits", rebuilt), body)


def redact(column: str) -> Column:
    """The column with every winning span replaced; NULL stays NULL, twice is the same as once.

    Built as one SQL expression over a column name: it is parsed once instead of being
    assembled call by call, which keeps planning fast.
    """
    return F.expr(redact_sql(column))


def redacted_line(column: str) -> Column:
    """Sanitise, redact, sanitise again: one clean line; NULL becomes ''."""
    def clean(x: str) -> str:
        return f"trim(regexp_replace(coalesce({x}, ''), {_text(WHITESPACE + '+')}, ' '))"

    return F.expr(_bound(clean(column), "line", clean(redact_sql("line"))))
