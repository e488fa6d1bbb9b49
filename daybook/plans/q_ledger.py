"""Queries over the ledger tables, landing and the summary hand-off."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.text import mask_tail
from daybook.operators import landing as la
from daybook.operators import ledger as lg
from daybook.operators import projection as pj
from daybook.operators import summaries as sm
from daybook.plans.adapters import SETTINGS, adapt
from daybook.plans.registry import block, query
from daybook.session import checkpoint_dir

NOW = date(1998, 1, 1)

block("stamped_t", "SELECT * FROM ledger_days WHERE state = 'stamped' OR seq % 31 = 0")
block("queue_t", "SELECT * FROM ledger_days WHERE state = 'queued'")
block("held_t", "SELECT * FROM ledger_days WHERE state = 'held' OR (state = 'queued' AND seq % 13 = 0)")
block("owner_t", "SELECT person_id FROM cards WHERE CAST(substr(person_id, 5) AS BIGINT) % 50 = 1")
block("live_t", """
  SELECT key, claim_id, lease_until FROM claims WHERE lease_until > DATE '1998-01-01'
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY lease_until DESC, claim_id) = 1""")
block("item_t", """
  SELECT CASE WHEN seq % 29 <> 0 THEN key END AS key, day, person_id, direction, topic,
    CASE WHEN seq % 23 = 0 THEN link || ')' ELSE link END AS link, seq, custkey FROM queue_t""")
block("interaction_t", """
  SELECT person_id, key, day, '- ' || CAST(day AS VARCHAR) || ' — conversation (' || direction || '): ' || topic
    || ' (→ ' || link || ')' AS pointer
  FROM ledger_days WHERE person_id IS NOT NULL AND (state = 'stamped' OR seq % 9 = 0)""")
block("card_t", "SELECT * FROM cards WHERE CAST(substr(person_id, 5) AS BIGINT) % 37 <> 0")


def state_tables(spark, base):
    days = adapt(spark, base, "ledger_days")
    return {"days": days,
            "stamped": days.filter("state = 'stamped' OR seq % 31 = 0"),
            "queue": days.filter("state = 'queued'"),
            "held": days.filter("state = 'held' OR (state = 'queued' AND seq % 13 = 0)")}


def owners_of(spark, base):
    return adapt(spark, base, "cards").filter("CAST(substr(person_id, 5) AS BIGINT) % 50 = 1").select(
        "person_id")


def interactions_of(days):
    return days.filter("person_id IS NOT NULL AND (state = 'stamped' OR seq % 9 = 0)").select(
        "person_id", "key", "day", la.pointer_line(
            F.date_format("day", "yyyy-MM-dd"), F.col("direction"), F.col("topic"),
            F.col("link")).alias("pointer"))


def items_of(queue):
    return queue.select(
        F.when(F.col("seq") % 29 != 0, F.col("key")).alias("key"), "day", "person_id", "direction",
        "topic", F.when(F.col("seq") % 23 == 0, F.concat("link", F.lit(")"))).otherwise(
            F.col("link")).alias("link"), "seq")


block("counted", """
  SELECT c.* FROM change_log c JOIN runs r ON r.segment = c.segment
  WHERE r.committed OR c.op = 'stamp_intent'""")


@query("a20_apply_change_log", """
  SELECT tbl, key, op, record FROM (
    SELECT *, row_number() OVER (PARTITION BY tbl, key ORDER BY seq DESC) AS rn FROM (
      SELECT e.*, max(seq) FILTER (WHERE NOT is_set AND kind <> 'late drop')
          OVER (PARTITION BY tbl, key) AS removed_at
      FROM (
        SELECT seq, op, key, record, tbl, is_set, '' AS kind FROM counted JOIN (VALUES
          ('stamp_intent', 'stamped', true), ('stamp_done', 'stamped', true),
          ('drop_intent', 'stamped', false), ('set_identifier', 'identifiers', true),
          ('enqueue', 'queue', true), ('refresh_links', 'queue', true), ('dequeue', 'queue', false),
          ('stamp_done', 'queue', false), ('claim', 'claims', true),
          ('release_claim', 'claims', false), ('record_failure', 'failures', true),
          ('clear_failure', 'failures', false), ('stamp_done', 'failures', false),
          ('hold', 'held', true)) k(kop, tbl, is_set) ON kop = op) e)
    WHERE is_set)
  WHERE rn = 1 AND (removed_at IS NULL OR removed_at < seq
      OR (tbl = 'stamped' AND op = 'stamp_done'))
    AND NOT (tbl = 'held' AND EXISTS (SELECT 1 FROM counted r WHERE r.op = 'release'
      AND r.key = split_part(tops.key, '|', 1) AND r.seq > tops.seq))""".replace(
          "WHERE is_set)\n", "WHERE is_set) tops\n"))
def _(spark, base):
    return lg.apply_change_log(adapt(spark, base, "change_log"), adapt(spark, base, "runs"))


@query("j9_unseen_units", """
  SELECT key FROM ledger_days WHERE state = 'unseen' AND seq % 31 <> 0""")
def _(spark, base):
    t = state_tables(spark, base)
    return lg.unseen_units(t["days"], t["stamped"], t["queue"], t["held"]).select("key")


@query("j10_release_held", """
  SELECT h.key, r.person_id AS found_person FROM held_t h
  JOIN (SELECT ident, person_id FROM ledger_identifiers WHERE state = 'accepted') r
    ON r.ident = h.ident
  WHERE h.key NOT IN (SELECT key FROM stamped_t) AND h.key NOT IN (SELECT key FROM queue_t)
    AND r.person_id NOT IN (SELECT person_id FROM owner_t)""")
def _(spark, base):
    t = state_tables(spark, base)
    resolved = adapt(spark, base, "ledger_identifiers").filter("state = 'accepted'")
    return lg.release_held(t["held"], resolved, t["stamped"], t["queue"],
                           owners_of(spark, base)).select("key", "found_person")


@query("j11_live_claims", "SELECT key, claim_id, CAST(lease_until AS VARCHAR) AS lease_until "
                          "FROM live_t")
def _(spark, base):
    return lg.live_claims(adapt(spark, base, "claims"), NOW).select(
        "key", "claim_id", F.date_format("lease_until", "yyyy-MM-dd").alias("lease_until"))


@query("j11_expired_claims", """
  SELECT claim_id, CAST(max(lease_until) AS VARCHAR) AS lease_until FROM claims GROUP BY claim_id
  HAVING max(lease_until) <= DATE '1998-01-01'""")
def _(spark, base):
    return lg.expired_claims(adapt(spark, base, "claims"), NOW).select(
        "claim_id", F.date_format("lease_until", "yyyy-MM-dd").alias("lease_until"))


@query("j13_settle_open_intents", """
  SELECT l.key, CASE WHEN EXISTS (SELECT 1 FROM interaction_t i WHERE i.person_id = l.person_id
      AND i.pointer = '- ' || CAST(l.day AS VARCHAR) || ' — conversation (' || l.direction || '): '
        || l.topic || ' (→ ' || l.link || ')') THEN 'done' ELSE 'dropped' END AS settled
  FROM ledger_days l WHERE l.seq % 6 = 0""")
def _(spark, base):
    days = adapt(spark, base, "ledger_days")
    intents = days.filter("seq % 6 = 0").select("key", "person_id", la.pointer_line(
        F.date_format("day", "yyyy-MM-dd"), F.col("direction"), F.col("topic"),
        F.col("link")).alias("pointer"))
    return lg.settle_open_intents(intents, interactions_of(days)).select("key", "settled")


@query("u5_link_growth", """
  SELECT key, pos, link, false AS is_new FROM links_seen WHERE queued
  UNION ALL
  SELECT s.key, c.last_pos + 1 + min(s.pos) AS pos, s.link, true
  FROM links_seen s JOIN (SELECT key, max(pos) AS last_pos FROM links_seen WHERE queued
    GROUP BY key) c ON c.key = s.key
  WHERE NOT s.queued AND s.key NOT IN (SELECT key FROM stamped_t)
    AND NOT EXISTS (SELECT 1 FROM links_seen o WHERE o.queued AND o.key = s.key AND o.link = s.link)
  GROUP BY s.key, s.link, c.last_pos""")
def _(spark, base):
    links = adapt(spark, base, "links_seen")
    return lg.grow_links(links.filter("queued"), links.filter("NOT queued"),
                         state_tables(spark, base)["stamped"])


@query("a16_identifier_rollup", """
  SELECT coalesce(b.ident, c.ident) AS ident,
    CAST(least(b.lo, c.lo) AS VARCHAR) AS first_seen, CAST(greatest(b.hi, c.hi) AS VARCHAR) AS last_seen,
    coalesce(c.n, 0) + coalesce(b.fresh, 0) AS days
  FROM (SELECT ident, min(day) AS lo, max(day) AS hi, count(*) FILTER (WHERE state = 'unseen') AS fresh
        FROM ledger_days WHERE day >= DATE '1996-01-01' GROUP BY ident) b
  FULL JOIN (SELECT ident, min(day) AS lo, max(day) AS hi, count(*) AS n
        FROM ledger_days WHERE day < DATE '1997-01-01' AND state <> 'unseen' GROUP BY ident) c
    ON b.ident = c.ident""")
def _(spark, base):
    days = adapt(spark, base, "ledger_days")
    current = days.filter("day < DATE '1997-01-01' AND state <> 'unseen'").groupBy("ident").agg(
        F.min("day").alias("first_seen"), F.max("day").alias("last_seen"),
        F.count(F.lit(1)).alias("days"))
    return lg.identifier_rollup(days.filter("day >= DATE '1996-01-01'"), current,
                                days.filter("state <> 'unseen'")).select(
        "ident", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"),
        F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "days")


@query("a17_filed_and_waiting", """
  SELECT ident, CAST(sum(f) AS BIGINT) AS filed, CAST(sum(w) AS BIGINT) AS waiting FROM (
    SELECT ident, 1 AS f, 0 AS w FROM stamped_t UNION ALL SELECT ident, 0, 1 FROM queue_t)
  GROUP BY ident""")
def _(spark, base):
    t = state_tables(spark, base)
    return lg.filed_and_waiting(t["stamped"], t["queue"])


@query("a19_failure_counts", """
  SELECT key, count(*) AS attempts, arg_max(detail, at_no) AS detail FROM failure_log
  WHERE key NOT IN (SELECT key FROM stamped_t) GROUP BY key""")
def _(spark, base):
    return lg.failure_counts(adapt(spark, base, "failure_log"), state_tables(spark, base)["stamped"])


@query("a7_waiting_counts", """
  SELECT count(*) FILTER (WHERE state = 'pending' OR (state = 'attach_pending'
      AND proposal_id IS NOT NULL)) AS on_queue,
    count(*) FILTER (WHERE state IN ('held', 'ambiguous') OR (state = 'attach_pending'
      AND proposal_id IS NULL)) AS on_review FROM ledger_identifiers""")
def _(spark, base):
    return lg.waiting_counts(adapt(spark, base, "ledger_identifiers"))


@query("a8_ledger_status", """
  SELECT (SELECT count(*) FROM ledger_days WHERE state = 'stamped') AS stamped,
    (SELECT count(*) FROM ledger_days WHERE state = 'held') AS held_units,
    (SELECT count(*) FROM queue_t) AS queued,
    (SELECT CAST(min(day) AS VARCHAR) FROM queue_t) AS oldest_day,
    (SELECT count(*) FROM queue_t WHERE key NOT IN (SELECT key FROM live_t)) AS unclaimed,
    (SELECT count(DISTINCT ident) FROM ledger_days WHERE state = 'held') AS held_identifiers,
    (SELECT count(*) FROM ledger_identifiers) AS identifiers,
    (SELECT count(*) FROM ledger_identifiers WHERE state = 'held') AS state_held,
    (SELECT count(*) FROM ledger_identifiers WHERE state = 'accepted') AS state_accepted,
    (SELECT count(*) FROM ledger_identifiers WHERE state = 'pending') AS state_pending,
    (SELECT count(*) FROM ledger_identifiers WHERE state = 'attach_pending') AS state_attach_pending,
    (SELECT count(*) FROM ledger_identifiers WHERE state = 'dismissed') AS state_dismissed,
    (SELECT count(*) FROM ledger_identifiers WHERE state = 'ambiguous') AS state_ambiguous,
    (SELECT count(DISTINCT claim_id) FROM live_t WHERE key IN (SELECT key FROM queue_t)) AS live_claims,
    (SELECT count(DISTINCT key) FROM failure_log) AS failures""")
def _(spark, base):
    return lg.ledger_status(
        adapt(spark, base, "ledger_days"), adapt(spark, base, "ledger_identifiers"),
        adapt(spark, base, "claims"), adapt(spark, base, "failure_log").select("key").distinct(),
        NOW).withColumn("oldest_day", F.date_format("oldest_day", "yyyy-MM-dd"))


# --- landing ----------------------------------------------------------------------------------

block("stale_t", """
  SELECT * FROM queue_t WHERE queued_at IS NOT NULL
    AND datediff('day', queued_at, DATE '1998-01-01') >= 3
    AND key NOT IN (SELECT key FROM stamped_t) AND key NOT IN (SELECT key FROM live_t)""")


@query("p9_stale_due", "SELECT key, CAST(day AS VARCHAR) AS day FROM stale_t")
def _(spark, base):
    t = state_tables(spark, base)
    live = lg.live_claims(adapt(spark, base, "claims"), NOW)
    return la.stale_due(t["queue"], t["stamped"], live, NOW, SETTINGS).select(
        "key", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _landing(spark, base, items):
    t = state_tables(spark, base)
    cards = adapt(spark, base, "cards").filter("CAST(substr(person_id, 5) AS BIGINT) % 37 <> 0")
    return la.landing_outcomes(items, t["stamped"], owners_of(spark, base), cards,
                               interactions_of(t["days"]))


_OUTCOME = """
  CASE WHEN i.key IS NULL THEN 'no key'
    WHEN i.key IN (SELECT key FROM stamped_t) THEN 'skipped'
    WHEN i.person_id IS NULL THEN 'refused: no person'
    WHEN i.person_id IN (SELECT person_id FROM owner_t) THEN 'refused: owner'
    WHEN i.person_id NOT IN (SELECT person_id FROM card_t) THEN 'failure: no card'
    WHEN contains(i.link, ')') THEN 'failure: refused line'
    WHEN EXISTS (SELECT 1 FROM interaction_t x WHERE x.person_id = i.person_id AND x.pointer =
      '- ' || CAST(i.day AS VARCHAR) || ' — conversation (' || i.direction || '): ' || i.topic
      || ' (→ ' || i.link || ')') THEN 'already_present' ELSE 'stamped' END"""


@query("k4_land", f"SELECT i.seq, i.key, {_OUTCOME} AS outcome FROM item_t i")
def _(spark, base):
    items = items_of(state_tables(spark, base)["queue"])
    return _landing(spark, base, items).select("seq", "key", "outcome")


@query("k4_no_copy_no_line", f"""
  SELECT seq, key, CASE WHEN outcome = 'stamped' AND CAST(substr(person_id, 5) AS BIGINT) % 2 = 1
    THEN 'failure: no copy' ELSE outcome END AS outcome
  FROM (SELECT i.*, {_OUTCOME} AS outcome FROM item_t i)""")
def _(spark, base):
    copies = adapt(spark, base, "cards").filter("CAST(substr(person_id, 5) AS BIGINT) % 2 = 0")
    items = items_of(state_tables(spark, base)["queue"])
    return la.land_copied(_landing(spark, base, items), copies).select("seq", "key", "outcome")


@query("p9_stale_landing", f"""
  SELECT seq, CASE WHEN done >= 200 THEN 'remaining' ELSE outcome END AS outcome FROM (
    SELECT *, count(*) FILTER (WHERE outcome = 'stamped') OVER (ORDER BY day, key
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done
    FROM (SELECT i.*, {_OUTCOME} AS outcome FROM stale_t i))""")
def _(spark, base):
    t = state_tables(spark, base)
    live = lg.live_claims(adapt(spark, base, "claims"), NOW)
    due = la.stale_due(t["queue"], t["stamped"], live, NOW, SETTINGS)
    return la.limit_landing(_landing(spark, base, due), SETTINGS.max_stamps).select("seq", "outcome")


@query("k5_first_touch_snapshot", """
  SELECT c.person_id, c.name FROM cards c
  WHERE c.person_id IN (SELECT person_id FROM queue_t)
    AND c.person_id NOT IN (SELECT person_id FROM owner_t)""")
def _(spark, base):
    """Written in two runs, the second done twice; the owners' cards were copied before."""
    t, cards = state_tables(spark, base), adapt(spark, base, "cards")
    path = f"{checkpoint_dir(spark)}/copies-{uuid.uuid4().hex}"
    la.copy_first_touch(cards, path, owners_of(spark, base), 0)
    for run in (1, 2, 2):
        la.copy_first_touch(cards, path, t["queue"].filter(F.col("seq") % 2 < run), run)
    return spark.read.parquet(path).filter("batch > 0").select("person_id", "name")


@query("k8_project_changed", """
  SELECT i.person_id, count(*) AS lines, CAST(max(i.day) AS VARCHAR) AS last_contacted FROM interaction_t i
  WHERE i.person_id IN (SELECT person_id FROM ledger_days WHERE day >= DATE '2001-07-01')
  GROUP BY i.person_id""")
def _(spark, base):
    days = adapt(spark, base, "ledger_days")
    touched = days.filter("day >= DATE '2001-07-01'").select("person_id")
    rows, path = interactions_of(days), f"{checkpoint_dir(spark)}/projected-{uuid.uuid4().hex}"
    earlier = rows.filter("day < DATE '2001-07-01'")
    pj.write_projection(earlier, earlier, path, 0, 500)
    for _again in range(2):
        pj.write_projection(rows, touched, path, 1, 500)
    return (pj.read_projection(spark, path, rows.schema, touched).groupBy("person_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_contacted")))


# Every fifth person's lines go, and every seventh keeps one; all others stay as they were.
@query("k8_emptied_persons", """
  SELECT person_id, count(*) AS lines, CAST(max(day) AS VARCHAR) AS last_contacted FROM (
    SELECT *, CAST(substr(person_id, 5) AS BIGINT) AS no, row_number() OVER (PARTITION BY person_id
      ORDER BY day, "key") AS nth FROM interaction_t)
  WHERE no % 5 <> 0 AND (no % 7 <> 0 OR nth = 1) GROUP BY person_id""")
def _(spark, base):
    rows = interactions_of(adapt(spark, base, "ledger_days"))
    path = f"{checkpoint_dir(spark)}/projected-{uuid.uuid4().hex}"
    pj.write_projection(rows, rows, path, 0, 500)
    no = F.col("person_id").substr(5, 8).cast("bigint")
    first = F.row_number().over(W.partitionBy("person_id").orderBy("day", "key")) == 1
    left = rows.withColumn("_first", first).filter((no % 7 != 0) | F.col("_first")).drop("_first")
    pj.write_projection(left.filter(no % 5 != 0), rows.filter((no % 5 == 0) | (no % 7 == 0)), path, 1)
    return pj.read_projection(spark, path, rows.schema).groupBy("person_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.date_format(F.max("day"), "yyyy-MM-dd").alias("last_contacted"))


# --- the summary hand-off ------------------------------------------------------------------------


def _presence(days):
    links = days.filter("state = 'queued'").select("key", "link").unionByName(
        days.filter("state = 'queued' AND seq % 2 = 0").select(
            "key", F.concat("link", F.lit(".old")).alias("link")))
    return sm.link_presence(links, days.filter("seq % 5 <> 0").select("link"))


block("presence_t", """
  SELECT key, CAST(sum(CASE WHEN has THEN 1 ELSE 0 END) AS BIGINT) AS found,
    CAST(sum(CASE WHEN has THEN 0 ELSE 1 END) AS BIGINT) AS missing FROM (
    SELECT key, seq % 5 <> 0 AS has FROM queue_t
    UNION ALL SELECT key, false FROM queue_t WHERE seq % 2 = 0) GROUP BY key""")
block("ready_t", """
  SELECT q.*, q.key IN (SELECT key FROM live_t) AS is_held, seq % 5 <> 0 AS has_transcript
  FROM queue_t q WHERE q.key NOT IN (SELECT key FROM stamped_t)""")


@query("x14_link_presence", "SELECT key, found, missing FROM presence_t")
def _(spark, base):
    return _presence(adapt(spark, base, "ledger_days"))


def _ready(spark, base):
    t = state_tables(spark, base)
    live = lg.live_claims(adapt(spark, base, "claims"), NOW)
    return sm.claimable(t["queue"], t["stamped"], live, _presence(t["days"]))


@query("t2_claim_pick", """
  SELECT key, CAST(day AS VARCHAR) AS day FROM ready_t WHERE NOT is_held AND has_transcript
  ORDER BY ready_t.day, key LIMIT 15""")
def _(spark, base):
    return sm.claim_pick(_ready(spark, base), SETTINGS.claim_limit).select(
        "key", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("t2_claim_counts", """
  SELECT waiting, held_by_others, no_transcript, claimed,
    greatest(waiting - claimed - no_transcript, 0) AS left_waiting FROM (
    SELECT count(*) FILTER (WHERE NOT is_held) AS waiting, count(*) FILTER (WHERE is_held)
        AS held_by_others,
      count(*) FILTER (WHERE NOT is_held AND NOT has_transcript AND picked < 15) AS no_transcript,
      least(15, count(*) FILTER (WHERE NOT is_held AND has_transcript)) AS claimed
    FROM (SELECT *, count(*) FILTER (WHERE NOT is_held AND has_transcript) OVER (ORDER BY day, key
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS picked FROM ready_t))""")
def _(spark, base):
    return sm.claim_counts(_ready(spark, base), SETTINGS.claim_limit)


#: A handle of the given tables as a list shows it.
MASKED = "'…' || right(regexp_replace(ident, '[^0-9]', '', 'g'), 4)"

block("batched_t", """
  SELECT *, CAST(floor((no - 1) / 15) AS BIGINT) AS batch,
    'u' || lpad(CAST((no - 1) % 15 + 1 AS VARCHAR), 2, '0') AS unit_id
  FROM (SELECT *, row_number() OVER (ORDER BY day, key) AS no FROM ready_t
        WHERE NOT is_held AND has_transcript)""")


def _batches(spark, base):
    return sm.claim_batches(_ready(spark, base).filter("NOT is_held AND has_transcript"),
                            SETTINGS.claim_limit)


@query("k3_write_claim_batch", f"""
  SELECT claim_id, '{{"format":1,"kind":"summary-claim","claim_id":"' || claim_id || '","units":['
    || string_agg('{{"id":"' || unit_id || '","key":"' || key || '","name":"' || name
      || '","day":"' || CAST(day AS VARCHAR) || '","direction":"' || direction || '","link":"'
      || link || '","mechanical_topic":"' || topic || '"}}', ',' ORDER BY unit_id)
    || '],"summaries":{{}}}}' AS document
  FROM (SELECT *, 'claim-' || lpad(CAST(batch AS VARCHAR), 6, '0') AS claim_id,
          coalesce(person_id, {MASKED}) AS name FROM batched_t) GROUP BY claim_id""")
def _(spark, base):
    """Written to Parquet and read back; a second write leaves the same documents."""
    units = _batches(spark, base).select(
        F.format_string("claim-%06d", "batch").alias("claim_id"), "unit_id", "key",
        F.coalesce("person_id", mask_tail(F.col("ident"))).alias("name"),
        F.date_format("day", "yyyy-MM-dd").alias("day"), "direction", "link", "topic")
    path = f"{checkpoint_dir(spark)}/claims-{uuid.uuid4().hex}"
    for _again in range(2):
        sm.write_claim_documents(sm.claim_documents(units), path)
    return spark.read.parquet(path)


@query("w9_unit_ids", """
  SELECT unit_id, count(*) AS documents FROM batched_t GROUP BY unit_id""")
def _(spark, base):
    return _batches(spark, base).groupBy("unit_id").agg(F.count(F.lit(1)).alias("documents"))


@query("x13_parse_summary_docs", """
  SELECT claim_id, CASE seq % 11 WHEN 0 THEN 'not a claim document' WHEN 1 THEN 'format or kind'
    WHEN 2 THEN 'format or kind' WHEN 3 THEN 'claim id' WHEN 4 THEN 'unit ids'
    WHEN 5 THEN 'unit ids' WHEN 6 THEN 'summaries' END AS problem FROM claim_docs""")
def _(spark, base):
    return sm.parse_summary_docs(adapt(spark, base, "claim_docs")).select("claim_id", "problem")


block("good_doc", """
  SELECT l.*, 'claim-' || l.seq AS claim_id, CASE WHEN l.seq % 3 = 0 THEN topic
    ELSE 'we agreed on plan ' || l.seq END AS said
  FROM ledger_days l WHERE l.seq % 11 > 6""")


@query("j16_summaries_to_units", """
  SELECT claim_id, key, CASE WHEN key IN (SELECT key FROM stamped_t)
      THEN 'skipped: already on the card'
    WHEN state <> 'queued' THEN 'skipped: no longer waiting'
    WHEN seq % 7 = 0 THEN 'skipped: taken by another'
    WHEN seq % 17 = 0 THEN 'released: late link'
    WHEN seq % 5 = 2 THEN 'refused: two summaries'
    WHEN seq % 5 IN (3, 4) THEN 'released: none written'
    WHEN seq % 3 = 0 THEN 'refused: restates the line' ELSE 'landed' END AS outcome
  FROM good_doc""")
def _(spark, base):
    t = state_tables(spark, base)
    units, texts = sm.summary_rows(sm.parse_summary_docs(adapt(spark, base, "claim_docs")))
    late = t["days"].filter("seq % 17 = 0").select("key")
    return sm.summaries_to_units(units, texts, t["queue"], t["stamped"],
                                 adapt(spark, base, "holders"), late).drop("unit_id")


@query("u6_unknown_summaries", """
  SELECT claim_id, 'u77' AS name FROM good_doc WHERE seq % 5 = 4""")
def _(spark, base):
    return sm.unknown_summaries(*sm.summary_rows(
        sm.parse_summary_docs(adapt(spark, base, "claim_docs"))))
