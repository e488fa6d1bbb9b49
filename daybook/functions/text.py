"""Column jobs on text: one-line bodies, handles, slugs, labels, masks, keys."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.config import E164_MAX_DIGITS, OPENER_MAX, SHORTCODE_MIN_DIGITS, SLUG_MAX

# --- fixed values: patterns -----------------------------------------------------------
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
ARROW_OPEN = r"(?U)\(\s*→"
OBJECT_REPLACEMENT = "\ufffc"
KEY_PATTERN = r"(?s)^(.+)\|day\|([0-9]{4}-[0-9]{2}-[0-9]{2})$"
E164_PATTERN = r"^\+[1-9][0-9]{6,14}$"
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SCRUB_CONTROL = r"[\x00-\x1f\x7f-\x9f\u2028\u2029]"
SCRUB_EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
SCRUB_PHONE = r"\+\d{7,15}|\d{10,}"
SCRUB_DASH = r"(?U)\s*—\s*"
ONE_TOPIC = r"(?s)^(Texts \(\d+\)): (.*)$"
GROUP_TOPIC = r"(?s)^(Group texts in )(.*)( \(\d+ messages\))$"
LINK_NAME = r"^(\d{4}-\d{2}-\d{2})-(.*)-(\d+)\.txt$"
# --- end of fixed values --------------------------------------------------------------


def strip(c: Column) -> Column:
    """Unicode-aware trim (Spark's own ``trim`` removes plain spaces only)."""
    return F.regexp_replace(c, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def sanitise_body(c: Column) -> Column:
    """Any value as one line: every break and run of whitespace becomes one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITESPACE + "+", " "))


def clean_label(c: Column) -> Column:
    """A name or handle column: trimmed, blank becomes NULL."""
    return F.nullif(strip(c), F.lit(""))


def clean_body(c: Column) -> Column:
    """A body without attachment placeholders; NULL (unreadable) and '' (no words) stay apart."""
    return strip(F.replace(c, F.lit(OBJECT_REPLACEMENT), F.lit("")))


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def normalise_handle(c: Column) -> Column:
    """The one spelling a phone number or address is keyed by; NULL when it is neither.

    Written as a chain in which each step reads the one before once: digits with a leading
    plus kept, then eleven digits from 1 gain the plus, then seven to fourteen gain ``+1``.
    Shorter runs are short codes and longer ones sender ids; both stay bare.
    """
    bare = F.regexp_replace(c, rf"^{WHITESPACE}*(\+)|[^0-9]", "$1")
    plus = F.regexp_replace(bare, r"^(1[0-9]{10})$", "+$1")
    full = F.regexp_replace(
        plus, rf"^([0-9]{{{SHORTCODE_MIN_DIGITS},{E164_MAX_DIGITS - 1}}})$", "+1$1")
    phone = F.try_element_at(F.regexp_extract_all(full, F.lit(r"(\+?[0-9]+)"), 1), F.lit(1))
    return F.when(c.contains("@"), F.lower(strip(c))).otherwise(phone)


def is_shortcode(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\+?[0-9]{1,6}$"), F.lit(False))


def valid_identifier(c: Column) -> Column:
    return F.coalesce(F.when(c.contains("@"), c.rlike(EMAIL_PATTERN))
                      .otherwise(c.rlike(E164_PATTERN)), F.lit(False))


# --- slugs ------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str], str]:
    """Accent folding as data, built from the Unicode tables by rule.

    Returns the two strings for ``translate`` (one character to one), the map of
    characters that decompose to several, and a regex class of combining marks.
    """
    one_from, one_to, several, marks = [], [], {}, []
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(code)
            continue
        plain = "".join(p for p in unicodedata.normalize("NFKD", ch)
                        if not unicodedata.combining(p))
        if plain == ch or not any(p.isascii() and p.isalnum() for p in plain):
            continue
        if len(plain) == 1:
            one_from.append(ch)
            one_to.append(plain)
        else:
            several[ch] = plain
    ranges, start = [], None
    for i, code in enumerate(marks):
        start = code if start is None else start
        if i + 1 == len(marks) or marks[i + 1] != code + 1:
            ranges.append(rf"\x{{{start:x}}}-\x{{{code:x}}}")
            start = None
    return "".join(one_from), "".join(one_to), several, "[" + "".join(ranges) + "]"


def fold_marks(c: Column) -> Column:
    """Compatibility-decompose and drop combining marks, inside the JVM."""
    one_from, one_to, several, marks = _folding()
    folded = F.translate(F.regexp_replace(c, marks, ""), one_from, one_to)
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in several.items())),
                         F.lit("\x01"), F.lit("\x02"))
    wide = F.array_join(F.transform(F.split(folded, ""),
                                    lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(wide)


def slug_label(c: Column) -> Column:
    """A label reduced to ``[a-z0-9-]``, never empty."""
    dashed = F.trim(F.regexp_replace(F.lower(fold_marks(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.trim(F.substring(dashed, 1, SLUG_MAX), F.lit("-"))
    plain = F.when(c.isNull() | (strip(c) == ""), F.lit("label")).otherwise(
        F.concat(F.lit("label-"), F.substring(F.sha1(strip(c)), 1, 8)))
    return F.coalesce(F.nullif(cut, F.lit("")), plain)


# --- topics and keys --------------------------------------------------------------------


def cut_opener(body: Column) -> Column:
    """At most eighty characters, the ellipsis included."""
    return F.when(F.length(body) > OPENER_MAX,
                  F.concat(F.rtrim(F.substring(body, 1, OPENER_MAX - 1)), F.lit("…"))
                  ).otherwise(body)


def safe_topic(topic: Column) -> Column:
    """A topic that cannot be read as the start of a link."""
    cleaned = strip(F.regexp_replace(topic, ARROW_OPEN, "(->"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("Texts"))


def topic_line(is_group: Column, chat_name: Column, messages: Column, opener: Column) -> Column:
    """The mechanical line: a one-to-one quotes its opener, a group quotes nothing."""
    count = messages.cast("string")
    name = F.coalesce(F.nullif(sanitise_body(chat_name), F.lit("")), F.lit("an unnamed group"))
    group = F.concat(F.lit("Group texts in "), name,
                     F.lit(" ("), count, F.lit(" messages)"))
    single = F.concat(F.lit("Texts ("), count, F.lit(")"))
    has_opener = F.coalesce(opener, F.lit("")) != ""
    return (F.when(is_group, group)
            .when(has_opener, F.concat(single, F.lit(": "), opener))
            .otherwise(single))


def unit_key(ident: Column, day: Column) -> Column:
    return F.concat(ident, F.lit("|day|"), F.date_format(day, "yyyy-MM-dd"))


def key_ident(key: Column) -> Column:
    """The identifier of a key, NULL when the key is not one."""
    return F.when(key_day(key).isNotNull(), F.regexp_extract(key, KEY_PATTERN, 1))


def key_day(key: Column) -> Column:
    """The day of a key, NULL for anything that is not a real calendar day."""
    text = F.regexp_extract(key, KEY_PATTERN, 2)
    return F.try_to_timestamp(F.when(text != "", text), F.lit("yyyy-MM-dd")).cast("date")


# --- masks, scrubbing, words ------------------------------------------------------------


def mask_shape(c: Column) -> Column:
    """A handle's shape with nothing identifying left: ``+<11 digits>``."""
    local = F.substring_index(c, "@", 1)
    domain = F.substring(c, F.instr(c, "@") + 1, F.length(c))
    return (F.when(c.contains("@"), F.format_string("<local %d>@<domain %d>",
                                                    F.length(local), F.length(domain)))
            .when(c.startswith("+"), F.format_string("+<%d digits>", F.length(c) - 1))
            .otherwise(F.format_string("<%d chars>", F.length(c))))


def mask_tail(c: Column) -> Column:
    """A handle as a list shows it: ``…0142`` or ``j…@example.com``."""
    c = F.coalesce(c, F.lit(""))
    domain = F.substring(c, F.instr(c, "@") + 1, F.length(c))
    return (F.when(c.contains("@"), F.concat(F.substring(F.substring_index(c, "@", 1), 1, 1),
                                             F.lit("…@"), domain))
            .otherwise(F.concat(F.lit("…"), F.right(only_digits(c), F.lit(4)))))


def mask_topic(c: Column) -> Column:
    """Structure and counts stay, quoted words and names become their length."""
    return (F.when(c.rlike(ONE_TOPIC), F.format_string(
                "%s: <%d chars>", F.regexp_extract(c, ONE_TOPIC, 1),
                F.length(F.regexp_extract(c, ONE_TOPIC, 2))))
            .when(c.rlike(GROUP_TOPIC), F.format_string(
                "%s<%d chars>%s", F.regexp_extract(c, GROUP_TOPIC, 1),
                F.length(F.regexp_extract(c, GROUP_TOPIC, 2)), F.regexp_extract(c, GROUP_TOPIC, 3)))
            .otherwise(F.format_string("<%d chars>", F.length(c))))


def mask_link(c: Column) -> Column:
    """A transcript link with the label taken out of the file name."""
    name = F.substring_index(c, "/", -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(name))
    masked = (F.when(name.rlike(LINK_NAME), F.format_string(
                  "%s-<%d chars>-%s.txt", F.regexp_extract(name, LINK_NAME, 1),
                  F.length(F.regexp_extract(name, LINK_NAME, 2)),
                  F.regexp_extract(name, LINK_NAME, 3)))
              .otherwise(F.format_string("<%d chars>", F.length(name))))
    return F.concat(head, masked)


def scrub_line(c: Column) -> Column:
    """One clean line: no control characters, no phone number, no address, no em dash."""
    flat = F.regexp_replace(c, SCRUB_CONTROL, " ")
    flat = F.regexp_replace(flat, SCRUB_EMAIL, "[address]")
    flat = F.regexp_replace(flat, SCRUB_PHONE, "[number]")
    flat = F.regexp_replace(flat, SCRUB_DASH, "; ")
    return sanitise_body(flat)


def cap_line(c: Column, limit: int) -> Column:
    """``c`` cut to ``limit`` characters at a word boundary past half of it."""
    head = F.substring(c, 1, limit - 1)
    cut = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    kept = F.when(cut >= limit // 2, F.substring(head, F.lit(1), cut)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(F.regexp_replace(kept, r"[ ,;:.\-]+$", ""), F.lit("…")))


def word_list(c: Column) -> Column:
    """Lower-case word tokens of an ASCII (or already folded) name."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)


def word_text(c: Column) -> Column:
    return F.array_join(word_list(c), " ")


def display_name(first: Column, last: Column, organisation: Column) -> Column:
    """First and last name, else the organisation, else NULL."""
    personal = F.concat_ws(" ", clean_label(first), clean_label(last))
    return F.when(personal != "", personal).otherwise(clean_label(organisation))


def looks_like_identifier(c: Column) -> Column:
    return c.contains("@") | ((F.length(only_digits(c)) >= SHORTCODE_MIN_DIGITS)
                              & ~c.rlike(r"(?U)\p{L}"))
