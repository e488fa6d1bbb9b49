"""Queries over the identifier state machine and the review list."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from daybook.operators import ledger as lg
from daybook.operators import resolve as rs
from daybook.operators import review as rv
from daybook.operators import settle as st
from daybook.plans.adapters import SETTINGS, adapt
from daybook.plans.q_ledger import NOW, owners_of, state_tables
from daybook.plans.q_people import resolution_blocks
from daybook.plans.registry import block, query
from daybook.session import checkpoint_dir, durable
from daybook.sources import people as pp

TODAY = date(2001, 6, 1)
OWNERS = "(SELECT person_id FROM owner_t)"

block("l_asked_ident", """
  SELECT a.ident, coalesce(c.name, i.name) AS name, a.newest, a.evidence FROM (
    SELECT ident, max(day) AS newest, max(day) FILTER (WHERE direction = 'i_reached_out') AS evidence
    FROM (SELECT ident, day, direction FROM ledger_days
          UNION ALL SELECT ident, NULL, NULL FROM ledger_identifiers) GROUP BY ident) a
  LEFT JOIN contacts c ON c.ident = a.ident
  LEFT JOIN ledger_identifiers i ON i.ident = a.ident""")
resolution_blocks("l_")
block("dismissal", """
  SELECT proposal_id, max(created) AS dismissed_on FROM proposal_log WHERE action = 'dismissed'
  GROUP BY proposal_id""")
block("made", """
  SELECT p.proposal_id, 'prs_' || lpad(regexp_extract(g.detail, 'customer-([0-9]+)', 1), 8, '0')
      AS new_person
  FROM proposals p JOIN proposal_log g ON g.proposal_id = p.proposal_id AND g.action = 'accepted'
  WHERE p.kind = 'new_stub' AND p.status = 'accepted' AND g.detail IS NOT NULL""")
block("dinput", f"""
  SELECT r.*, i.state, i.hold_reason, i.proposal_id, i.person_id AS record_person, i.match_person,
    p.status AS pstate, m.new_person, d.proposal_id AS dismissed_id, w.proposal_id AS pending_id,
    w.kind AS pending_kind, w.proposal_name AS stub_name, w.proposal_person AS pending_person,
    x.dismissed_on AS own_day, y.dismissed_on AS other_day,
    r.person_id IN {OWNERS} AS is_owner, m.new_person IN {OWNERS} AS new_is_owner,
    coalesce(r.attach_to = m.new_person, false) OR coalesce(k.person_id = m.new_person, false)
      AS follows, k.person_id AS record_attach
  FROM l_resolution r LEFT JOIN ledger_identifiers i ON i.ident = r.ident
  LEFT JOIN proposals p ON p.proposal_id = i.proposal_id LEFT JOIN cards k ON k.name = i.name
  LEFT JOIN made m ON m.proposal_id = i.proposal_id
  LEFT JOIN newest_proposal d ON d.ident = r.ident AND d.status = 'dismissed'
  LEFT JOIN newest_proposal w ON w.ident = r.ident AND w.status = 'pending'
  LEFT JOIN dismissal x ON x.proposal_id = i.proposal_id
  LEFT JOIN dismissal y ON y.proposal_id = d.proposal_id""")


def _decide_sql(emit: bool, again: bool) -> str:
    def no(day: str) -> str:
        yes = f"evidence > {day}" if again else "false"
        return (f"CASE WHEN coalesce({yes}, false) THEN 'hold/reopened/pending' "
                "ELSE 'hold/dismissed/dismissed' END")

    recent = ("WHEN newest >= DATE '2001-06-01' - 7 THEN 'raise/' || proposal_kind || '/pending'"
              if emit else "")
    return f"""CASE
      WHEN status = 'resolved' AND coalesce(state = 'dismissed' AND hold_reason = 'wrong_match'
        AND match_person = person_id, false) THEN 'hold/wrong_match/dismissed'
      WHEN status = 'resolved' AND is_owner THEN 'owner/owner/'
      WHEN status = 'resolved' THEN 'queue/' || route || '/accepted'
      WHEN state = 'dismissed' AND proposal_id IS NULL THEN 'hold/dismissed/dismissed'
      WHEN state = 'attach_pending' AND proposal_id IS NULL AND record_person IS NOT NULL
        THEN 'hold/attach_pending/attach_pending'
      WHEN status = 'ambiguous' THEN 'hold/ambiguous/ambiguous'
      WHEN state IN ('pending', 'attach_pending') AND proposal_id IS NOT NULL
          AND pstate IS NOT NULL THEN CASE pstate
        WHEN 'pending' THEN 'hold/' || state || '/' || state
        WHEN 'dismissed' THEN {no('own_day')}
        ELSE CASE WHEN state = 'attach_pending' THEN 'hold/cannot_attach/held'
          WHEN new_person IS NULL THEN 'hold/accepted_unknown/pending'
          WHEN new_is_owner THEN 'owner/owner/'
          WHEN coalesce(follows, false) THEN 'raise/attach_pending/attach_pending'
          ELSE 'hold/accepted_unattached/pending' END END
      WHEN state = 'dismissed' AND pstate = 'dismissed' THEN {no('own_day')}
      WHEN state IN ('held', 'ambiguous') THEN 'hold/' || coalesce(hold_reason, state) || '/' || state
      WHEN dismissed_id IS NOT NULL THEN {no('other_day')}
      WHEN pending_id IS NOT NULL THEN 'hold/pending/pending'
      {recent}
      ELSE 'hold/new/held' END"""


block("decided", f"SELECT *, {_decide_sql(False, False)} AS decision FROM dinput")
block("decided_emit", f"SELECT *, {_decide_sql(True, True)} AS decision FROM dinput")


def review_frames(spark, base) -> dict:
    f = state_tables(spark, base)
    cards, ids = adapt(spark, base, "cards"), adapt(spark, base, "ledger_identifiers")
    card_ids = pp.card_identifiers(cards)
    days = f["days"].groupBy("ident").agg(
        F.max("day").alias("newest"),
        F.max(F.when(F.col("direction") == "i_reached_out", F.col("day"))).alias("evidence"))
    asked = (ids.select("ident").unionByName(f["days"].select("ident")).distinct()
             .join(days, "ident", "left")
             .join(adapt(spark, base, "contacts").select("ident", F.col("name").alias("contact")),
                   "ident", "left")
             .join(ids.select("ident", F.col("name").alias("stored")), "ident", "left")
             .select("ident", F.coalesce("contact", "stored").alias("name"), "newest", "evidence"))
    slugs = cards.select(F.concat(F.lit("customer-"), F.col("person_id").substr(5, 8).cast("bigint")
                                  .cast("string")).alias("slug"), "person_id")
    raw = adapt(spark, base, "proposals")
    f.update(cards=cards, ids=ids, proposals=raw, log=adapt(spark, base, "proposal_log"),
             newest=durable(pp.newest_proposals(raw)), parsed=pp.parsed_proposals(raw),
             owners=owners_of(spark, base), asked=asked,
             resolved=rs.resolve_identifiers(asked, card_ids, cards))
    f["inputs"] = rv.decision_inputs(f["resolved"], ids, raw, f["newest"], f["log"], slugs,
                                     f["owners"], cards)
    return f


def _decision(df):
    return df.select("ident", F.concat_ws("/", "outcome", "reason", F.coalesce(
        "new_state", F.lit(""))).alias("decision"))


@query("m1_decide_identifiers", "SELECT ident, decision FROM decided")
def _(spark, base):
    return _decision(rv.decide_identifiers(review_frames(spark, base)["inputs"], TODAY))


@query("m1_decide_with_emit", "SELECT ident, decision FROM decided_emit")
def _(spark, base):
    return _decision(rv.decide_identifiers(review_frames(spark, base)["inputs"], TODAY, emit=True,
                                           reopen_dismissed=True))


@query("m2_follow_through", """
  SELECT ident, 'add_identifier' AS kind, new_person AS person_id FROM decided
  WHERE decision = 'raise/attach_pending/attach_pending'""")
def _(spark, base):
    return rv.follow_through(rv.decide_identifiers(review_frames(spark, base)["inputs"], TODAY))


@query("m8_raise_proposals", """
  SELECT ident, split_part(decision, '/', 2) AS kind FROM decided_emit
  WHERE starts_with(decision, 'raise/') AND NOT contains(decision, 'attach_pending')""")
def _(spark, base):
    f = review_frames(spark, base)
    decided = rv.decide_identifiers(f["inputs"], TODAY, emit=True, reopen_dismissed=True)
    return rv.raise_proposals(decided, f["parsed"])


block("justified", """
  SELECT p.proposal_id, p.ident, d.dismissed_on, a.evidence
  FROM parsed_proposal p JOIN dismissal d ON d.proposal_id = p.proposal_id
  JOIN l_asked_ident a ON a.ident = p.ident
  WHERE p.status = 'dismissed' AND a.evidence > d.dismissed_on""")


@query("j12_reopen_justified", """
  SELECT proposal_id, ident, CAST(dismissed_on AS VARCHAR) AS dismissed_on,
    CAST(evidence AS VARCHAR) AS evidence FROM justified""")
def _(spark, base):
    f = review_frames(spark, base)
    return rv.reopen_justified(f["asked"], f["parsed"], f["log"]).select(
        "proposal_id", "ident", F.date_format("dismissed_on", "yyyy-MM-dd").alias("dismissed_on"),
        F.date_format("evidence", "yyyy-MM-dd").alias("evidence"))


@query("m7_reopen", """
  SELECT p.proposal_id, CASE WHEN j.proposal_id IS NOT NULL THEN 'pending' ELSE p.status END
    AS status, j.proposal_id IS NOT NULL AS logged
  FROM proposals p LEFT JOIN justified j ON j.proposal_id = p.proposal_id""")
def _(spark, base):
    f = review_frames(spark, base)
    justified = rv.reopen_justified(f["asked"], f["parsed"], f["log"])
    changed, rows = rv.reopen(f["proposals"], justified, TODAY)
    logged = rows.select("proposal_id", F.lit(True).alias("_l"))
    return changed.join(logged, "proposal_id", "left").select(
        "proposal_id", "status", F.coalesce("_l", F.lit(False)).alias("logged"))


# --- the review list ----------------------------------------------------------------------------

block("attach_input", """
  SELECT *, CASE WHEN state = 'attach_pending' THEN record_person
    WHEN state = 'pending' AND pstate = 'accepted' THEN new_person END AS attach_person
  FROM dinput WHERE state IS NOT NULL AND state <> 'accepted'""")
block("listing_section", """
  SELECT *, CASE WHEN state = 'dismissed' AND coalesce(hold_reason, '') = 'wrong_match'
      THEN 'note: wrong_match'
    WHEN state = 'dismissed' THEN 'note: dismissed'
    WHEN NOT regexp_full_match(ident, '[+][1-9][0-9]{6,14}') THEN 'not_a_number'
    WHEN status = 'resolved' AND is_owner THEN 'note: owner'
    WHEN status = 'resolved' THEN 'note: resolved'
    WHEN dismissed_id IS NOT NULL THEN 'note: dismissed'
    WHEN attach_person IS NOT NULL THEN 'attach' WHEN status = 'ambiguous' THEN 'ambiguous'
    WHEN pending_kind = 'new_stub' THEN CASE WHEN stub_name IS NOT NULL THEN 'new' ELSE 'bare' END
    WHEN pending_kind = 'add_identifier' THEN CASE WHEN pending_person IS NOT NULL THEN 'known'
      ELSE 'ambiguous' END
    WHEN proposal_kind = 'add_identifier' THEN CASE WHEN name_candidates = 1 THEN 'known'
      ELSE 'ambiguous' END
    WHEN name IS NOT NULL THEN 'new' ELSE 'bare' END AS section FROM attach_input""")
block("listing", """
  SELECT s.ident, s.section, s.name, coalesce(h.days, 0) AS days, h.first, h.last, s.state,
    CASE s.section WHEN 'attach' THEN attach_person WHEN 'known' THEN coalesce(
      CASE WHEN pending_kind = 'add_identifier' THEN pending_person END, attach_to) END AS target,
    CASE s.section WHEN 'attach' THEN coalesce(pending_kind = 'add_identifier'
        AND pending_person = attach_person, false) OR coalesce(attach_to = attach_person, false)
        OR coalesce(record_attach = attach_person, false)
      WHEN 'known' THEN true WHEN 'new' THEN true ELSE false END AS can_accept,
    s.section = 'bare' AS needs_name
  FROM listing_section s LEFT JOIN (SELECT ident, count(*) AS days, min(day) AS first,
    max(day) AS last FROM held_t GROUP BY ident) h ON h.ident = s.ident""")
block("ranked", """
  SELECT *, row_number() OVER (ORDER BY CASE section WHEN 'attach' THEN 1 WHEN 'known' THEN 2
      WHEN 'new' THEN 3 WHEN 'bare' THEN 4 WHEN 'not_a_number' THEN 5 ELSE 6 END,
    days DESC, last DESC NULLS LAST, lower(name) NULLS LAST, ident) AS label
  FROM listing WHERE NOT starts_with(section, 'note')""")


def listing(f: dict):
    return rv.classify_review(f["inputs"], f["newest"], f["held"])


def ranked(spark, base):
    f = review_frames(spark, base)
    f["ranked"] = rv.review_rank(listing(f))
    return f


@query("m3_classify_review", """
  SELECT ident, section, name, days, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last,
    state, target, can_accept, needs_name FROM listing""")
def _(spark, base):
    return listing(review_frames(spark, base)).select(
        "ident", "section", "name", "days", F.date_format("first", "yyyy-MM-dd").alias("first"),
        F.date_format("last", "yyyy-MM-dd").alias("last"), "state", "target", "can_accept",
        "needs_name")


@query("m4_check_matches", f"""
  SELECT r.ident, r.person_id, r.matched_value, r.matched_digits,
    (SELECT count(*) FROM stamped_t s WHERE s.ident = r.ident) AS filed,
    (SELECT count(*) FROM queue_t q WHERE q.ident = r.ident) AS waiting
  FROM l_resolution r JOIN ledger_identifiers i ON i.ident = r.ident
  WHERE i.state = 'accepted' AND coalesce(i.match_route, '') <> 'exact' AND r.status = 'resolved'
    AND r.route = 'suffix' AND r.person_id NOT IN {OWNERS}
    AND coalesce(i.match_confirmed, '') <> r.person_id""")
def _(spark, base):
    f = review_frames(spark, base)
    return rv.check_matches(f["inputs"], f["ids"], lg.filed_and_waiting(f["stamped"], f["queue"]))


@query("w8_review_rank", "SELECT label, ident, section, days FROM ranked")
def _(spark, base):
    return ranked(spark, base)["ranked"].select("label", "ident", "section", "days")


_CELLS = ("can_accept", "days", "first", "ident", "label", "last", "name", "needs_name", "section",
          "state", "target")


@query("a18_listing_fingerprint", f"""
  SELECT count(*) AS rows, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {', '.join(
    f"CAST(sum(CAST('0x' || substr(code, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)"
    for i in range(4))})) AS token
  FROM (SELECT sha256(concat_ws(chr(31), {', '.join(
    f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in _CELLS)})) AS code FROM ranked)""")
def _(spark, base):
    return rv.listing_fingerprint(ranked(spark, base)["ranked"])


block("step", """
  SELECT d.label, d.action, d.name AS decided_name, r.ident, r.section,
    coalesce(r.target, CASE WHEN d.action = 'accept' THEN k.person_id END) AS target,
    CASE WHEN r.ident IS NULL THEN 'no such row'
      WHEN (SELECT count(DISTINCT e.action) FROM decisions e WHERE e.label = d.label) > 1
        THEN 'accepted and dismissed'
      WHEN d.action = 'accept' AND d.name IS NOT NULL AND r.section NOT IN ('new', 'bare')
        THEN 'the row already has a card'
      WHEN d.action = 'accept' AND NOT r.can_accept AND NOT r.needs_name THEN 'cannot be accepted'
      WHEN d.action = 'accept' AND r.needs_name AND d.name IS NULL THEN 'needs a name' END AS refusal
  FROM decisions d LEFT JOIN ranked r ON r.label = d.label LEFT JOIN cards k ON k.name = d.name""")


def steps(spark, base):
    f = ranked(spark, base)
    f["steps"] = rv.decisions_to_listing(adapt(spark, base, "decisions"), f["ranked"],
                                         adapt(spark, base, "cards"))
    return f


@query("j17_decisions_to_listing", """
  SELECT label, action, decided_name, ident, section, target, refusal FROM step""")
def _(spark, base):
    return steps(spark, base)["steps"]


@query("j17_whole_batch", """
  SELECT 'all' AS batch, label, action, coalesce(refusal, (SELECT arg_min(refusal, label * 2
      + CASE action WHEN 'accept' THEN 0 ELSE 1 END) FROM step WHERE refusal IS NOT NULL)) AS refusal
  FROM step
  UNION ALL SELECT 'good', label, action, NULL FROM step WHERE refusal IS NULL
  UNION ALL SELECT 'late', label, action, 'the list has changed' FROM step WHERE refusal IS NULL""")
def _(spark, base):
    """One batch with refusals, one without, and one made for a list that has changed since."""
    f = steps(spark, base)
    good = f["steps"].filter("refusal IS NULL")
    token = rv.listing_fingerprint(f["ranked"]).first()["token"]
    batches = [rv.whole_batch(rows, f["ranked"], code).select(
        F.lit(name).alias("batch"), "label", "action", "refusal")
        for name, rows, code in (("all", f["steps"], token), ("good", good, token),
                                 ("late", good, "another list"))]
    return batches[0].unionByName(batches[1]).unionByName(batches[2])


@query("t7_dismiss_below", """
  SELECT label, ident FROM ranked WHERE label > 40""")
def _(spark, base):
    f = ranked(spark, base)
    return rv.dismiss_below(f["ranked"], 40).join(f["ranked"].select("label", "ident"), "label").select(
        "label", "ident")


block("accepted_step", """
  SELECT DISTINCT ident, target, CASE WHEN target IS NOT NULL THEN 'accepted' ELSE 'attach_pending'
    END AS new_state FROM step WHERE action = 'accept' AND refusal IS NULL""")


@query("m5_apply_accepts", f"""
  SELECT a.ident, a.new_state, a.target AS person_id,
    (SELECT count(*) FROM held_t h WHERE h.ident = a.ident AND a.new_state = 'accepted'
       AND a.target NOT IN {OWNERS} AND h.key NOT IN (SELECT key FROM stamped_t)
       AND h.key NOT IN (SELECT key FROM queue_t)) AS released
  FROM accepted_step a""")
def _(spark, base):
    f = steps(spark, base)
    known = f["stamped"].select("key").unionByName(f["queue"].select("key"))
    updates, released = rv.apply_accepts(f["steps"], f["held"], known, f["owners"])
    counts = released.groupBy("ident").agg(F.count(F.lit(1)).alias("released"))
    return updates.join(counts, "ident", "left").select(
        "ident", "new_state", "person_id", F.coalesce("released", F.lit(0)).alias("released"))


# By the time of the yes another card has every fourth number, and the directory refuses every fifth.
block("settled", f"""
  SELECT a.ident, a.target, CASE WHEN a.target IS NULL THEN 'second_yes'
    WHEN CAST(right(a.ident, 7) AS BIGINT) % 5 = 0 THEN 'left_pending'
    WHEN CAST(right(a.ident, 7) AS BIGINT) % 4 = 0 OR EXISTS (SELECT 1 FROM card_ident k
      WHERE k.ident = a.ident AND k.person_id <> a.target) THEN 'cannot_attach'
    ELSE 'done' END AS outcome, a.section, coalesce(a.target IN {OWNERS}, false) AS own
  FROM (SELECT DISTINCT ident, target, section FROM step WHERE action = 'accept' AND refusal IS NULL) a""")
block("settled_day", """
  SELECT h.ident, h.key, CASE WHEN s.own THEN 'owner_dropped'
    WHEN h.key IN (SELECT key FROM stamped_t) OR h.key IN (SELECT key FROM queue_t) THEN 'already'
    ELSE 'queued' END AS went
  FROM settled s JOIN held_t h ON h.ident = s.ident WHERE s.outcome = 'done'""")


def settled(spark, base):
    f = steps(spark, base)
    f["steps"] = durable(f["steps"])
    no = F.right("ident", F.lit(7)).cast("bigint")
    card_ids = pp.card_identifiers(f["cards"]).select("ident", "person_id")
    others = f["steps"].filter(no % 4 == 0).select("ident", F.lit("prs_99999999").alias("person_id"))
    return st.settle_accepts(
        f["steps"], f["asked"], card_ids.unionByName(others), f["cards"],
        f["steps"].filter(no % 5 == 0).select("ident"), f["held"], f["stamped"], f["queue"],
        f["owners"])


@query("m5_settle_accepts", """
  SELECT s.ident, s.outcome, CASE s.outcome WHEN 'done' THEN 'accepted' WHEN 'cannot_attach' THEN 'held'
      WHEN 'left_pending' THEN CASE s.section WHEN 'attach' THEN 'attach_pending' ELSE 'pending' END
      ELSE 'attach_pending' END AS new_state,
    CASE s.outcome WHEN 'cannot_attach' THEN 'cannot_attach' END AS hold_reason, s.target AS person_id,
    CASE s.outcome WHEN 'done' THEN 'exact' END AS match_route,
    (SELECT count(*) FROM settled_day d WHERE d.ident = s.ident AND d.went = 'queued') AS queued,
    (SELECT count(*) FROM settled_day d WHERE d.ident = s.ident AND d.went = 'already') AS already,
    (SELECT count(*) FROM settled_day d WHERE d.ident = s.ident AND d.went = 'owner_dropped')
      AS owner_dropped
  FROM settled s""")
def _(spark, base):
    return settled(spark, base)[0]


@query("m5_released_days", """
  SELECT d.ident, d.key, s.target AS person_id FROM settled_day d JOIN settled s ON s.ident = d.ident
  WHERE d.went = 'queued'""")
def _(spark, base):
    return settled(spark, base)[1].select("ident", "key", "person_id")


@query("m6_apply_dismissals", """
  SELECT ident, 'dismissed' AS new_state, CAST(NULL AS VARCHAR) AS hold_reason FROM step
  WHERE action = 'dismiss' AND refusal IS NULL""")
def _(spark, base):
    return rv.apply_dismissals(steps(spark, base)["steps"])


@query("m6_wrong_matches", f"""
  SELECT q.key, q.ident, r.person_id AS match_person, 'wrong_match' AS reason
  FROM queue_t q JOIN l_resolution r ON r.ident = q.ident
  JOIN ledger_identifiers i ON i.ident = q.ident
  WHERE i.state = 'accepted' AND coalesce(i.match_route, '') <> 'exact' AND r.route = 'suffix'
    AND r.status = 'resolved' AND r.person_id NOT IN {OWNERS}
    AND coalesce(i.match_confirmed, '') <> r.person_id
    AND q.key NOT IN (SELECT key FROM stamped_t)""")
def _(spark, base):
    f = review_frames(spark, base)
    checks = rv.check_matches(f["inputs"], f["ids"], lg.filed_and_waiting(f["stamped"], f["queue"]))
    return rv.apply_wrong_matches(checks, f["queue"], f["stamped"])


block("check_row", f"""
  SELECT *, 'm' || row_number() OVER (ORDER BY days DESC, lower(coalesce(name, '')), ident) AS label,
    row_number() OVER (ORDER BY days DESC, lower(coalesce(name, '')), ident) AS no
  FROM (SELECT r.ident, r.person_id, k.name,
      (SELECT count(*) FROM stamped_t s WHERE s.ident = r.ident)
        + (SELECT count(*) FROM queue_t q WHERE q.ident = r.ident) AS days
    FROM l_resolution r JOIN ledger_identifiers i ON i.ident = r.ident
    LEFT JOIN cards k ON k.person_id = r.person_id
    WHERE i.state = 'accepted' AND coalesce(i.match_route, '') <> 'exact' AND r.status = 'resolved'
      AND r.route = 'suffix' AND r.person_id NOT IN {OWNERS}
      AND coalesce(i.match_confirmed, '') <> r.person_id)""")


def check_rows(f: dict, records):
    counts = f.get("counts")
    if counts is None:
        counts = lg.filed_and_waiting(f["stamped"], f["queue"])
    return st.check_rank(rv.check_matches(f["inputs"], records, counts), f["cards"])


def checked(spark, base):
    """Of every three matches to check one is confirmed, one is wrong and one is left."""
    f = review_frames(spark, base)
    # This list and the next are made from them.
    f["inputs"] = durable(f["inputs"])
    f["counts"] = durable(lg.filed_and_waiting(f["stamped"], f["queue"]))
    rows, path = check_rows(f, f["ids"]), f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    no = F.substring("label", 2, 20).cast("bigint")
    st.save_records(f["ids"], path, 0)
    for version, updates in ((1, st.confirmed(rows.filter(no % 3 == 1))),
                             (2, st.pinned(rows.filter(no % 3 == 2)))):
        st.save_records(st.changed_records(f["ids"], updates), path, version)
    f["checks"], f["records"] = rows, st.newest_records(spark, path, f["ids"].schema)
    return f


@query("w8_check_rank", "SELECT label, ident, person_id, days FROM check_row")
def _(spark, base):
    f = review_frames(spark, base)
    return check_rows(f, f["ids"]).select("label", "ident", "person_id", "days")


@query("m6_next_listing", """
  SELECT 'm' || row_number() OVER (ORDER BY no) AS label, ident, person_id FROM check_row
  WHERE no % 3 = 0""")
def _(spark, base):
    f = checked(spark, base)
    return check_rows(f, f["records"]).select("label", "ident", "person_id")


@query("m6_checked_decisions", """
  SELECT ident, CASE no % 3 WHEN 2 THEN 'hold/wrong_match/dismissed' ELSE 'queue/suffix/accepted' END
    AS decision FROM check_row""")
def _(spark, base):
    f = checked(spark, base)
    slugs = f["cards"].select(F.concat(F.lit("customer-"), F.col("person_id").substr(5, 8)
                                       .cast("bigint").cast("string")).alias("slug"), "person_id")
    inputs = rv.decision_inputs(f["resolved"], f["records"], f["proposals"], f["newest"], f["log"],
                                slugs, f["owners"], f["cards"])
    return _decision(rv.decide_identifiers(inputs, TODAY)).join(
        f["checks"].select("ident"), "ident", "left_semi")


# --- exclude and include ---------------------------------------------------------------------------

block("excluded_t", """
  SELECT w.ident, CASE WHEN w.listed THEN 'unchanged' ELSE 'change' END AS plan,
    (SELECT count(*) FROM queue_t q WHERE q.ident = w.ident
      AND q.key NOT IN (SELECT key FROM stamped_t)) AS queued_days,
    (SELECT count(*) FROM held_t h WHERE h.ident = w.ident) AS held_days,
    i.state IS NOT NULL AND i.state NOT IN ('accepted', 'dismissed') AS set_aside,
    CASE WHEN i.state NOT IN ('accepted', 'dismissed') THEN i.state END AS prior_state,
    CASE WHEN i.state NOT IN ('accepted', 'dismissed') THEN i.hold_reason END AS prior_reason
  FROM (SELECT DISTINCT ident, CAST(right(ident, 7) AS BIGINT) % 14 = 0 AS listed FROM ledger_days
        WHERE custkey % 7 = 0) w LEFT JOIN ledger_identifiers i ON i.ident = w.ident""")


def excluded(spark, base):
    f = state_tables(spark, base)
    wanted = f["days"].filter("custkey % 7 = 0").select("ident")
    listed = f["days"].filter("custkey % 14 = 0").select("ident")
    f["excluded"] = rv.exclude_plan(wanted, SETTINGS.own_handles, listed,
                                    adapt(spark, base, "ledger_identifiers"), f["queue"], f["held"],
                                    f["stamped"])
    return f


@query("j18_exclude_plan", "SELECT * FROM excluded_t")
def _(spark, base):
    return excluded(spark, base)["excluded"]


@query("j18_cancelled_claims", """
  SELECT DISTINCT l.claim_id FROM live_t l JOIN queue_t q ON q.key = l.key
  WHERE q.ident IN (SELECT ident FROM excluded_t)""")
def _(spark, base):
    f = excluded(spark, base)
    return rv.cancelled_claims(f["excluded"], f["queue"],
                               lg.live_claims(adapt(spark, base, "claims"), NOW))


@query("j18_include_plan", """
  SELECT ident, prior_state AS state, prior_reason AS hold_reason FROM excluded_t WHERE set_aside""")
def _(spark, base):
    return rv.include_plan(excluded(spark, base)["excluded"])
