"""DuckDB spellings of the column jobs, for the oracles only."""

WS = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
      r"\x{205f}\x{3000}]")


def sanitise(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def norm_handle(x: str) -> str:
    d, s = digits(x), strip(x)
    return (f"CASE WHEN {s} LIKE '%@%' THEN lower({s}) WHEN {d} = '' THEN NULL "
            f"WHEN starts_with({s}, '+') THEN '+' || {d} WHEN length({d}) < 7 THEN {d} "
            f"WHEN length({d}) = 11 AND {d}[1] = '1' THEN '+' || {d} "
            f"WHEN length({d}) > 14 THEN {d} ELSE '+1' || {d} END")


def shortcode(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '[+]?[0-9]{{1,6}}'), false)"


def slug(x: str) -> str:
    """ASCII labels only."""
    cut = f"trim(regexp_replace(lower({strip(x)}), '[^a-z0-9]+', '-', 'g'), '-')"
    cut = f"trim(substr({cut}, 1, 60), '-')"
    return (f"CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN 'label' WHEN {cut} = '' "
            f"THEN 'label-' || substr(sha1({strip(x)}), 1, 8) ELSE {cut} END")


def redacted(x: str) -> str:
    """The rules that the planted message bodies can trigger, in RE2."""
    code = (r"(?i)(verification code[^0-9\n.!?;]{0,24}?)([0-9]{4,10})\b")
    tail = (r"(?i)(\bending in )([0-9]{4})\b")
    return (f"regexp_replace(regexp_replace({sanitise(x)}, '{code}', '\\1[redacted]', 'g'), "
            f"'{tail}', '\\1[redacted]', 'g')")
