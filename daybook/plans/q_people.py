"""Queries over contacts, cards and identity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions import text as X
from daybook.operators import resolve as rs
from daybook.plans.adapters import adapt
from daybook.plans.q_messages import day_text, folded
from daybook.plans.registry import block, query
from daybook.plans.sqltext import digits, norm_handle, slug, strip
from daybook.sources import people as pp

_NAME = ("nullif(concat_ws(' ', nullif(" + strip("first_name") + ", ''), nullif("
         + strip("last_name") + ", '')), '')")

block("contact_rows", f"""
  SELECT {norm_handle('raw')} AS ident, coalesce({_NAME}, nullif({strip('org')}, '')) AS name,
    store_rank, kind_rank, row_no
  FROM raw_contacts WHERE (raw LIKE '%@%') = (kind_rank = 1)""")
block("contact_map", """
  SELECT ident, name FROM contact_rows WHERE ident IS NOT NULL AND name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ident ORDER BY store_rank, kind_rank, row_no) = 1""")
block("card_ident", f"""
  SELECT DISTINCT person_id, name, {norm_handle('raw')} AS ident FROM (
    SELECT person_id, name, unnest([phone, shared_phone, email]) AS raw FROM cards)
  WHERE raw IS NOT NULL""")
block("asked_ident", """
  SELECT p.ident, c.name, max(p.day) AS newest, count(*) AS days,
    max(p.day) FILTER (WHERE p.outbound) AS evidence
  FROM person_day p LEFT JOIN contacts c ON c.ident = p.ident GROUP BY p.ident, c.name""")

def resolution_blocks(p: str) -> None:
    """Oracle blocks that resolve the identifiers of ``<p>asked_ident``."""
    block(p + "exact_pair", f"SELECT a.ident, k.person_id FROM {p}asked_ident a "
              "JOIN card_ident k USING (ident)")
    block(p + "suffix_pair", f"""
      SELECT a.ident, k.person_id, k.ident AS card_value, least(length({digits('a.ident')}),
        length({digits('k.ident')})) AS shared
      FROM {p}asked_ident a JOIN card_ident k
        ON right({digits('a.ident')}, 7) = right({digits('k.ident')}, 7)
      WHERE a.ident NOT LIKE '%@%' AND k.ident NOT LIKE '%@%'
        AND length({digits('a.ident')}) >= 7 AND length({digits('k.ident')}) >= 7
        AND (suffix({digits('a.ident')}, {digits('k.ident')})
             OR suffix({digits('k.ident')}, {digits('a.ident')}))
        AND a.ident NOT IN (SELECT ident FROM card_ident)""")
    block(p + "name_pair", f"""
      SELECT a.ident, k.person_id FROM {p}asked_ident a JOIN cards k
        ON array_to_string(regexp_extract_all(lower(a.name), '\\w+'), ' ')
         = array_to_string(regexp_extract_all(lower(k.name), '\\w+'), ' ')""")
    block(p + "resolution", f"""
      SELECT a.*,
        CASE WHEN e.n = 1 OR (e.n IS NULL AND s.n = 1) THEN 'resolved'
             WHEN coalesce(e.n, s.n) > 1 THEN 'ambiguous' ELSE 'proposed' END AS status,
        CASE WHEN e.n = 1 THEN e.p WHEN e.n IS NULL AND s.n = 1 THEN s.p END AS person_id,
        CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN s.n IS NOT NULL THEN 'suffix' END AS route,
        CASE WHEN e.n IS NULL THEN s.shared END AS matched_digits,
        CASE WHEN e.n IS NULL THEN s.card_value END AS matched_value,
        CASE WHEN e.n IS NULL AND s.n IS NULL THEN
          CASE WHEN n.n > 0 THEN 'add_identifier' ELSE 'new_stub' END END AS proposal_kind,
        CASE WHEN e.n IS NULL AND s.n IS NULL THEN coalesce(n.n, 0) ELSE 0 END AS name_candidates,
        CASE WHEN e.n IS NULL AND s.n IS NULL AND n.n = 1 THEN n.p END AS attach_to
      FROM {p}asked_ident a
      LEFT JOIN (SELECT ident, count(DISTINCT person_id) AS n, min(person_id) AS p FROM {p}exact_pair
                 GROUP BY ident) e ON e.ident = a.ident
      LEFT JOIN (SELECT ident, count(DISTINCT person_id) AS n, min(person_id) AS p,
                   max(shared) AS shared, max(card_value) AS card_value FROM {p}suffix_pair
                 GROUP BY ident) s ON s.ident = a.ident
      LEFT JOIN (SELECT ident, count(DISTINCT person_id) AS n, min(person_id) AS p FROM {p}name_pair
                 GROUP BY ident) n ON n.ident = a.ident""")


resolution_blocks("")


def asked(f: dict):
    """Each identifier once, with its newest day and its newest outbound one-to-one day."""
    return (f["person_days"].groupBy("ident").agg(
        F.max("day").alias("newest"), F.count(F.lit(1)).alias("days"),
        F.max(F.when(F.col("outbound"), F.col("day"))).alias("evidence"))
        .join(f["contacts"].select("ident", "name"), "ident", "left")
        .select("ident", "name", "newest", "days", "evidence"))


def resolution(spark, base, f: dict | None = None):
    f = f or folded(spark, base)
    cards = adapt(spark, base, "cards")
    f["cards"], f["card_ids"], f["asked"] = cards, pp.card_identifiers(cards), asked(f)
    f["resolved"] = rs.resolve_identifiers(f["asked"], f["card_ids"], cards)
    return f


@query("s6_scan_contacts", "SELECT ident, name FROM contact_map")
def _(spark, base):
    return pp.scan_contacts(adapt(spark, base, "raw_contacts"))


@query("s7_extract_dated_lines", r"""
  SELECT doc_id, substr(line, 3, 10) AS day,
    regexp_extract(line, 'conversation\s*\((\w+)\)', 1) AS direction,
    nullif(trim(regexp_replace(rest, '\(\s*→\s*[^)]+\)', '')), '') AS summary,
    nullif(trim(regexp_extract(rest, '\(\s*→\s*([^)]+)\)', 1)), '') AS link
  FROM (SELECT doc_id, line, regexp_extract(line,
          'conversation\s*\(\w+\)\s*:?\s*(.*)$', 1) AS rest
        FROM (SELECT doc_id, trim(unnest(string_split(
                string_split(string_split(text, '## Interactions')[2], '## ')[1], chr(10)))) AS line
              FROM card_text)
        WHERE regexp_matches(line,
          '^-\s+[0-9]{4}-[0-9]{2}-[0-9]{2}\s+[—–-]\s+conversation\s*\(\w+\)'))""")
def _(spark, base):
    return pp.dated_lines(adapt(spark, base, "card_text")).drop("at")


@query("s8_card_identifiers", "SELECT person_id, name, ident FROM card_ident")
def _(spark, base):
    return pp.card_identifiers(adapt(spark, base, "cards")).drop("kind")


@query("s9_labelled_addresses", r"""
  SELECT doc_id, address, label FROM (
    SELECT doc_id, label, no, unnest(found) AS address, unnest(range(len(found))) AS pos FROM (
      SELECT doc_id, no, CASE WHEN contains(line, '**Email:**') THEN 'Email' ELSE 'Google' END
          AS label, regexp_extract_all(line, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')
          AS found
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
              unnest(range(len(string_split(text, chr(10))))) AS no FROM profile_text)
      WHERE contains(line, '**Email:**') OR contains(line, '**Google:**')))
  QUALIFY row_number() OVER (PARTITION BY doc_id, lower(address) ORDER BY no, pos) = 1""")
def _(spark, base):
    return pp.labelled_addresses(adapt(spark, base, "profile_text"))


block("parsed_proposal", """
  SELECT *, payload ->> '$.identifier' AS ident, payload ->> '$.name' AS proposal_name,
    payload ->> '$.person' AS proposal_person
  FROM (SELECT * FROM proposals WHERE json_valid(payload))""")
block("newest_proposal", """
  SELECT ident, status, max(proposal_id) AS proposal_id,
    arg_max(kind, proposal_id) AS kind, arg_max(proposal_name, proposal_id) AS proposal_name,
    arg_max(proposal_person, proposal_id) AS proposal_person
  FROM parsed_proposal GROUP BY ident, status""")


@query("s10_scan_proposals", "SELECT ident, status, proposal_id, kind, proposal_name "
                             "FROM newest_proposal")
def _(spark, base):
    return pp.newest_proposals(adapt(spark, base, "proposals")).drop("proposal_person")


@query("x2_slug_labels", f"""
  SELECT {slug('name')} AS slug, count(*) AS rows, count(DISTINCT name) AS labels
  FROM (SELECT name FROM contact_rows UNION ALL SELECT name FROM cards
        UNION ALL SELECT replace(name, '#', ' (') || ')' FROM cards
        UNION ALL SELECT url FROM pages) GROUP BY 1""")
def _(spark, base):
    raw = adapt(spark, base, "raw_contacts").filter(
        F.col("raw").contains("@") == (F.col("kind_rank") == 1)).select(X.display_name(
            F.col("first_name"), F.col("last_name"), F.col("org")).alias("name"))
    cards = adapt(spark, base, "cards").select("name")
    wild = cards.select(F.concat(F.replace("name", F.lit("#"), F.lit(" (")), F.lit(")"))
                        .alias("name"))
    urls = adapt(spark, base, "pages").select(F.col("url").alias("name"))
    names = (raw.unionByName(cards).unionByName(wild).unionByName(urls)
             .groupBy("name").agg(F.count(F.lit(1)).alias("rows")))
    return (names.groupBy(X.slug_label(F.col("name")).alias("slug"))
            .agg(F.sum("rows").alias("rows"), F.count("name").alias("labels")))


@query("x10_contact_display_name", f"""
  SELECT store_rank, kind_rank, row_no, coalesce({_NAME}, nullif({strip('org')}, '')) AS name
  FROM raw_contacts""")
def _(spark, base):
    return adapt(spark, base, "raw_contacts").select(
        "store_rank", "kind_rank", "row_no",
        X.display_name(F.col("first_name"), F.col("last_name"), F.col("org")).alias("name"))


@query("x9_name_words", r"""
  SELECT person_id, array_to_string(regexp_extract_all(lower(name), '\w+'), ' ') AS words,
    contains(' ' || array_to_string(regexp_extract_all(lower(name), '\w+'), ' ') || ' ',
             ' 000000007 ') AS has_seven FROM cards""")
def _(spark, base):
    folded_cards = rs.folded_names(adapt(spark, base, "cards"), "name", "folded")
    words = X.word_text(F.col("folded"))
    return folded_cards.select(
        "person_id", words.alias("words"),
        F.concat(F.lit(" "), words, F.lit(" ")).contains(" 000000007 ").alias("has_seven"))


@query("p12_mask_identifiers", """
  SELECT handle_raw, CASE WHEN handle_raw LIKE '%@%' THEN '<local ' ||
      length(split_part(handle_raw, '@', 1)) || '>@<domain '
      || length(split_part(handle_raw, '@', 2)) || '>'
    WHEN starts_with(handle_raw, '+') THEN '+<' || (length(handle_raw) - 1) || ' digits>'
    ELSE '<' || length(handle_raw) || ' chars>' END AS shape,
    CASE WHEN handle_raw LIKE '%@%' THEN handle_raw[1] || '…@' || split_part(handle_raw, '@', 2)
    ELSE '…' || right(regexp_replace(handle_raw, '[^0-9]', '', 'g'), 4) END AS tail
  FROM (SELECT DISTINCT handle_raw FROM messages WHERE handle_raw IS NOT NULL)""")
def _(spark, base):
    return (adapt(spark, base, "messages").select("handle_raw").filter("handle_raw IS NOT NULL")
            .distinct().select("handle_raw", X.mask_shape(F.col("handle_raw")).alias("shape"),
                               X.mask_tail(F.col("handle_raw")).alias("tail")))


@query("p14_looks_like_identifier", """
  SELECT text, text LIKE '%@%' OR (length(regexp_replace(text, '[^0-9]', '', 'g')) >= 7
    AND NOT regexp_matches(text, '\\p{L}')) AS looks
  FROM (SELECT DISTINCT handle_raw AS text FROM messages WHERE handle_raw IS NOT NULL
        UNION SELECT name FROM cards UNION SELECT substr(name, 10) FROM cards)""")
def _(spark, base):
    cards = adapt(spark, base, "cards")
    texts = (adapt(spark, base, "messages").select(F.col("handle_raw").alias("text"))
             .filter("text IS NOT NULL").unionByName(cards.select(F.col("name").alias("text")))
             .unionByName(cards.select(F.substring("name", 10, 99).alias("text"))).distinct())
    return texts.select("text", X.looks_like_identifier(F.col("text")).alias("looks"))


# --- resolution -----------------------------------------------------------------------------


@query("j2_enrich_names", """
  SELECT u.key, coalesce(k.name, c.name, CASE WHEN u.turns > 1 THEN 'Stored ' || u.custkey END,
    '…' || right(u.ident, 4)) AS shown_name
  FROM ledger_days u LEFT JOIN cards k ON k.person_id = u.person_id
  LEFT JOIN contacts c ON c.ident = u.ident""")
def _(spark, base):
    records = adapt(spark, base, "ledger_days").select(
        "key", "ident", F.when(F.col("custkey") % 3 != 0, F.col("person_id")).alias("person_id"),
        F.when(F.col("turns") > 1, F.concat(F.lit("Stored "), F.col("custkey").cast("string")))
        .alias("stored_name"))
    return rs.enrich_names(records, adapt(spark, base, "cards"), adapt(spark, base, "contacts"),
                           X.mask_tail(F.col("ident"))).select("key", "shown_name")


_OWN = "(SELECT unnest(['+15550000001', '+15550000002', 'user24@example.com', '+15550000007', " \
       "'+15559999999']) AS ident)"


@query("j4_own_semijoin", f"""
  SELECT o.ident, min(k.person_id) AS person_id FROM {_OWN} o JOIN card_ident k
    ON k.ident = o.ident GROUP BY o.ident HAVING count(DISTINCT k.person_id) = 1
  UNION ALL
  SELECT o.ident, k.person_id FROM {_OWN} o JOIN card_ident k
    ON k.ident = '+555' || right(o.ident, 7) WHERE o.ident NOT IN (SELECT ident FROM card_ident)""")
def _(spark, base):
    cards = adapt(spark, base, "cards")
    own = spark.createDataFrame([("+15550000001",), ("+15550000002",), ("user24@example.com",),
                                 ("+15550000007",), ("+15559999999",)], "ident string")
    own = own.withColumn("name", F.lit(None).cast("string"))
    return (rs.resolve_identifiers(own, pp.card_identifiers(cards), cards)
            .filter("status = 'resolved'").select("ident", "person_id"))


@query("j5_match_exact", "SELECT ident, count(DISTINCT person_id) AS persons, min(person_id) AS lo, "
                         "max(person_id) AS hi FROM exact_pair GROUP BY ident")
def _(spark, base):
    f = folded(spark, base)
    card_ids = pp.card_identifiers(adapt(spark, base, "cards"))
    persons = card_ids.groupBy("ident").agg(F.count(F.lit(1)).alias("persons"))
    return rs.exact_matches(asked(f), card_ids).join(persons, "ident").select(
        "ident", "persons", "lo", "hi")


@query("j6_match_suffix", """
  SELECT ident, min(person_id) AS lo, max(person_id) AS hi, max(shared) AS shared,
    max(card_value) AS card_value FROM suffix_pair GROUP BY ident""")
def _(spark, base):
    f = folded(spark, base)
    return rs.suffix_matches(asked(f), pp.card_identifiers(adapt(spark, base, "cards")))


@query("j7_resolve_identifiers", """
  SELECT ident, name, status, person_id, route, matched_digits, matched_value, proposal_kind,
    name_candidates, attach_to FROM resolution""")
def _(spark, base):
    return resolution(spark, base)["resolved"].select(
        "ident", "name", "status", "person_id", "route", "matched_digits", "matched_value",
        "proposal_kind", "name_candidates", "attach_to")


@query("j7_ambiguous_candidates", """
  SELECT DISTINCT r.ident, p.person_id FROM resolution r
  JOIN (SELECT ident, person_id FROM exact_pair UNION ALL SELECT ident, person_id FROM suffix_pair)
    p ON p.ident = r.ident WHERE r.status = 'ambiguous'""")
def _(spark, base):
    f = resolution(spark, base)
    return rs.ambiguous_candidates(f["resolved"], f["card_ids"])


OWNER_PERSONS = ("prs_00000001",)


@query("j8_owner_antijoin", """
  SELECT u.key, r.person_id FROM unit u JOIN resolution r ON r.ident = u.ident
  WHERE r.status = 'resolved' AND r.person_id <> 'prs_00000001'""")
def _(spark, base):
    f = resolution(spark, base)
    owners = (rs.owner_persons(spark.createDataFrame([("+15550000001",)], "ident string"),
                               f["card_ids"], f["cards"]))
    found = f["resolved"].filter("status = 'resolved'").select("ident", "person_id")
    return (f["person_days"].join(found, "ident").join(owners, "person_id", "left_anti")
            .select("key", "person_id"))


_QUERIES = """
  SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN c_name
    WHEN 1 THEN substr(c_name, 10) WHEN 2 THEN substr(c_name, 10, 8)
    ELSE substr(c_name, 10) || ', CUSTOMER' END AS query FROM customer"""


@query("j14_match_people", f"""
  SELECT q.query_id, k.person_id, k.name, CASE q.query_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2
      WHEN 2 THEN 1 ELSE 3 END AS tier,
    CASE WHEN count(*) OVER (PARTITION BY q.query_id) > 1 THEN 'ambiguous' ELSE 'one' END AS status
  FROM ({_QUERIES}) q JOIN cards k ON CASE q.query_id % 4 WHEN 0 THEN k.name = q.query
    WHEN 1 THEN k.name = 'Customer#' || q.query
    WHEN 2 THEN starts_with(k.name, 'Customer#' || q.query)
    ELSE k.name || ', CUSTOMER' = 'Customer#' || q.query END""")
def _(spark, base):
    queries = spark.sql(_QUERIES.replace("FROM customer", "FROM {customer}"),
                        customer=adapt(spark, base, "customer"))
    return rs.match_people(queries, adapt(spark, base, "cards").select("person_id", "name"))


@query("j15_fold_contact_twins", """
  SELECT c.ident, c.name, min(k.person_id) AS person_id FROM contact_map c LEFT JOIN cards k
    ON array_to_string(list_sort(regexp_extract_all(lower(c.name), '\\w+')), ' ')
     = array_to_string(list_sort(regexp_extract_all(lower(k.name), '\\w+')), ' ')
  GROUP BY c.ident, c.name""")
def _(spark, base):
    return rs.fold_contact_twins(pp.scan_contacts(adapt(spark, base, "raw_contacts")),
                                 adapt(spark, base, "cards").select("person_id", "name"))


block("tie", """
  SELECT DISTINCT person_id, ident FROM (
    SELECT person_id, ident FROM ledger_identifiers
    UNION ALL SELECT person_id, ident FROM ledger_days WHERE state IN ('queued', 'stamped'))
  WHERE person_id IS NOT NULL""")


@query("a15_ledger_people", "SELECT person_id, ident FROM tie")
def _(spark, base):
    days = adapt(spark, base, "ledger_days")
    return rs.ledger_people(adapt(spark, base, "ledger_identifiers"),
                            days.filter("state = 'queued'"), days.filter("state = 'stamped'"))


@query("j19_identifier_to_person", """
  SELECT a.ident, coalesce(i.person_id, t.person_id, r.person_id) AS person_id,
    CASE WHEN i.person_id IS NOT NULL THEN 1 WHEN t.person_id IS NOT NULL THEN 2
         WHEN r.person_id IS NOT NULL THEN 3 END AS priority
  FROM (SELECT DISTINCT ident FROM ledger_days UNION SELECT ident FROM asked_ident) a
  LEFT JOIN (SELECT ident, person_id FROM ledger_identifiers WHERE state = 'accepted') i
    ON i.ident = a.ident
  LEFT JOIN (SELECT ident, min(person_id) AS person_id FROM tie GROUP BY ident) t
    ON t.ident = a.ident
  LEFT JOIN (SELECT ident, person_id FROM resolution WHERE status = 'resolved') r
    ON r.ident = a.ident""")
def _(spark, base):
    f = resolution(spark, base)
    days, ids = adapt(spark, base, "ledger_days"), adapt(spark, base, "ledger_identifiers")
    ties = rs.ledger_people(ids, days.filter("state = 'queued'"), days.filter("state = 'stamped'"))
    wanted = days.select("ident").unionByName(f["asked"].select("ident")).distinct()
    return rs.identifier_to_person(wanted, ids, ties, f["resolved"])


__all__ = ["OWNER_PERSONS", "asked", "day_text", "resolution"]
