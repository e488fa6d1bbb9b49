"""Queries for reports and for answering about a person."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from daybook.functions.text import mask_tail, safe_topic, topic_line
from daybook.operators import ledger as lg
from daybook.operators import reports as rp
from daybook.operators import resolve as rs
from daybook.operators import review as rv
from daybook.operators import show as sh
from daybook.operators import transcripts as tr
from daybook.operators.shape import side_by_side
from daybook.plans.adapters import SETTINGS, adapt
from daybook.plans.q_ledger import state_tables
from daybook.plans.q_messages import day_text, folded, stores
from daybook.plans.q_people import resolution
from daybook.plans.q_review import TODAY, review_frames
from daybook.plans.registry import block, query
from daybook.plans.sqltext import norm_handle
from daybook.sources import messages as ms
from daybook.sources import people as pp

FIRST, LAST = date(2024, 1, 1), date(2024, 1, 28)


block("own_evidence", f"""
  SELECT handle, CAST(coalesce(sum(n) FILTER (WHERE kind = 1), 0) AS BIGINT) AS messages,
    CAST(coalesce(sum(n) FILTER (WHERE kind = 2), 0) AS BIGINT) AS conversations,
    CAST(coalesce(sum(n) FILTER (WHERE kind = 3), 0) AS BIGINT) AS addressed,
    coalesce(bool_or(kind = 4), false) AS labelled
  FROM (SELECT {norm_handle("regexp_replace(trim(raw), '^[EPep]:', '')")} AS handle, kind, n FROM (
    SELECT m.account AS raw, 1 AS kind, 1 AS n FROM store_message m
      JOIN store_membership j ON j.message_id = m.rowid JOIN store_chat c ON c.rowid = j.chat_id
      WHERE m.is_from_me AND c.style = 45
    UNION ALL SELECT account_login, 2, 1 FROM store_chat WHERE style = 45
    UNION ALL SELECT last_addressed_handle, 3, 1 FROM store_chat WHERE style = 45
    UNION ALL SELECT unnest(regexp_extract_all(
        regexp_extract(text, '\\*\\*Email[^~]*', 0), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')),
      4, 1 FROM profile_text) WHERE raw IS NOT NULL) WHERE handle IS NOT NULL GROUP BY handle""")


def _evidence(spark, base):
    message, membership, chat, _ = stores(spark, base)
    return rp.own_handle_evidence(message, membership, chat, pp.labelled_addresses(
        adapt(spark, base, "profile_text")))


@query("a9_own_handle_evidence", "SELECT * FROM own_evidence")
def _(spark, base):
    return _evidence(spark, base)


@query("t5_own_handle_ranking", """
  SELECT handle, row_number() OVER (ORDER BY messages DESC, conversations DESC, addressed DESC,
    labelled DESC, handle) AS rank FROM own_evidence""")
def _(spark, base):
    return rp.rank_own_handles(_evidence(spark, base)).select("handle", "rank")


@query("a11_decode_health", """
  SELECT count(*) AS sampled, count(*) FILTER (WHERE length(trim(text)) > 0) AS readable,
    count(*) FILTER (WHERE length(trim(text)) > 0) / count(*) AS rate,
    count(*) FILTER (WHERE length(trim(text)) > 0) / count(*) >= 0.9 AS healthy
  FROM (SELECT text FROM messages ORDER BY sent_at DESC, date_raw DESC, rowid DESC LIMIT 2000)""")
def _(spark, base):
    return rp.decode_health(ms.sample_recent(adapt(spark, base, "messages")))


@query("a12_body_coverage_by_month", """
  SELECT strftime(sent_at, '%Y-%m') AS month, count(*) AS rows, count(text) AS with_text,
    count(text) / count(*) AS share FROM messages GROUP BY 1""")
def _(spark, base):
    return rp.coverage_by_month(adapt(spark, base, "messages"))


_IN = "day BETWEEN DATE '2024-01-01' AND DATE '2024-01-28'"


@query("a13_preview_counts", f"""
  SELECT (SELECT count(*) FROM prepared WHERE {_IN}) AS messages,
    (SELECT count(DISTINCT day) FROM prepared WHERE {_IN}) AS days_with_texts,
    (SELECT count(*) FROM chat_day WHERE {_IN}) AS chat_days,
    (SELECT count(*) FROM kept WHERE {_IN}) AS kept,
    (SELECT count(*) FROM chat_day WHERE {_IN}) - (SELECT count(*) FROM kept WHERE {_IN}) AS set_aside,
    (SELECT count(*) FROM person_day WHERE {_IN}) AS person_days,
    (SELECT count(DISTINCT ident) FROM person_day WHERE {_IN}) AS people""")
def _(spark, base):
    return rp.preview_counts(folded(spark, base), FIRST, LAST)


@query("t8_newest_samples", """
  SELECT CAST(l.day AS VARCHAR) AS day, l.link, CASE WHEN l.is_group THEN 'Group texts in ' ||
      coalesce(l.chat_name, 'an unnamed group') || ' (' || l.messages || ' messages)'
    WHEN coalesce(o.opener, '') <> '' THEN 'Texts (' || l.messages || '): ' || o.opener
    ELSE 'Texts (' || l.messages || ')' END AS topic
  FROM linked l LEFT JOIN opener o USING (chat_rowid, day) ORDER BY l.day DESC, chat_rowid DESC
  LIMIT 3""")
def _(spark, base):
    f = folded(spark, base)
    return (rp.newest_samples(f["linked"]).join(f["openers"], ["chat_rowid", "day"], "left").select(
        day_text(), "link", safe_topic(topic_line(F.col("is_group"), F.col("chat_name"),
                                                  F.col("messages"), F.col("opener"))).alias("topic")))


@query("a14_backfill_estimate", f"""
  SELECT *, CAST(ceil(2.5 + threads * 0.001 + person_days * 0.0001 + tranches * 0.1) AS BIGINT)
      AS seconds, CAST(ceil(queued / 200) AS BIGINT) AS mornings
  FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT chat_rowid, day FROM spoken WHERE {_IN})) AS threads,
      (SELECT count(*) FROM person_day WHERE {_IN}) AS person_days,
      (SELECT count(*) FROM person_day p JOIN resolution r ON r.ident = p.ident
       WHERE r.status = 'resolved' AND {_IN}) AS queued, 1::BIGINT AS tranches)""")
def _(spark, base):
    f = resolution(spark, base)
    queued = f["person_days"].join(f["resolved"].filter("status = 'resolved'").select("ident"),
                                   "ident", "left_semi")
    return rp.backfill_estimate(f, queued, FIRST, LAST, SETTINGS, 2.5)


block("tally", """
  SELECT split_part(d.decision, '/', 1) AS outcome, split_part(d.decision, '/', 2) AS reason,
    count(*) AS days, count(DISTINCT u.ident) AS identifiers
  FROM ledger_days u JOIN decided d ON d.ident = u.ident WHERE u.state = 'unseen' GROUP BY 1, 2""")


def _tally(spark, base):
    f = review_frames(spark, base)
    return rp.run_tally(f["days"].filter("state = 'unseen'"),
                        rv.decide_identifiers(f["inputs"], TODAY))


@query("a6_run_tally", "SELECT outcome, reason, days, identifiers FROM tally")
def _(spark, base):
    return _tally(spark, base)


@query("a6_why_nothing_queued", """
  SELECT CAST(0 AS BIGINT) AS queued, sum(days) || ' day(s) are held until their number is known' AS why
  FROM tally WHERE outcome = 'hold'""")
def _(spark, base):
    return rp.why_nothing(_tally(spark, base).filter("outcome <> 'queue'"))


@query("k7_brief_row", """
  SELECT to_json({'headline': 'Texts: ' || format('{:,}', came_in) || ' conversation-days in, '
      || format('{:,}', filed) || ' filed, ' || format('{:,}', waiting) || ' waiting for a summary, '
      || format('{:,}', review) || ' numbers to review',
    'items': [format('{:,}', failures) || ' days could not be filed and will be tried again.',
      format('{:,}', review) || ' numbers on the review list, holding ' || format('{:,}', held_days)
      || ' days.', format('{:,}', waiting) || ' days waiting for a summary, the oldest from '
      || oldest || '.']}) AS brief
  FROM (SELECT (SELECT count(*) FROM ledger_days) AS came_in,
    (SELECT count(*) FROM stamped_t) AS filed, (SELECT count(*) FROM queue_t) AS waiting,
    (SELECT count(*) FROM ledger_identifiers WHERE state IN ('held', 'ambiguous')
       OR (state = 'attach_pending' AND proposal_id IS NULL)) AS review,
    (SELECT count(*) FROM held_t) AS held_days,
    (SELECT count(DISTINCT key) FROM failure_log) AS failures,
    (SELECT CAST(min(day) AS VARCHAR) FROM queue_t) AS oldest)""")
def _(spark, base):
    t = state_tables(spark, base)

    def one(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))

    counts = side_by_side(
        one(t["days"], "came_in"), one(t["stamped"], "filed"), one(t["held"], "held_days"),
        t["queue"].agg(F.count(F.lit(1)).alias("waiting"), F.min("day").alias("oldest_day")),
        lg.waiting_counts(adapt(spark, base, "ledger_identifiers")).select(
            F.col("on_review").alias("review")),
        one(adapt(spark, base, "failure_log").select("key").distinct(), "failures"))
    return rp.brief_row(counts)


# --- answering about a person -----------------------------------------------------------------------

block("entry_t", """
  SELECT person_id, key, day, topic AS summary, seq, 'on_card' AS state FROM ledger_days
  WHERE person_id IS NOT NULL AND (state = 'stamped' OR seq % 31 = 0)
  UNION ALL
  SELECT person_id, key, day, topic, seq, 'waiting' FROM queue_t
  WHERE person_id IS NOT NULL AND key NOT IN (SELECT key FROM stamped_t)
  UNION ALL
  SELECT t.person_id, h.key, h.day, h.topic, h.seq, 'held' FROM held_t h JOIN tie t ON t.ident = h.ident
  WHERE h.key NOT IN (SELECT key FROM stamped_t)""")


def entries(spark, base):
    t = state_tables(spark, base)
    ties = rs.ledger_people(adapt(spark, base, "ledger_identifiers"),
                            t["days"].filter("state = 'queued'"),
                            t["days"].filter("state = 'stamped'"))
    worded = {n: t[n].withColumnRenamed("topic", "summary") for n in ("stamped", "queue", "held")}
    return sh.answer_union(worded["stamped"].filter("person_id IS NOT NULL"), worded["queue"],
                           worded["held"], t["stamped"], ties)


@query("u1_answer_union", """
  SELECT person_id, key, CAST(day AS VARCHAR) AS day, summary, state FROM entry_t""")
def _(spark, base):
    return entries(spark, base).select("person_id", "key", day_text(), "summary", "state")


@query("t3_show_newest_first", """
  SELECT person_id, key, state, pos, greatest(total - 5, 0) AS cut FROM (
    SELECT *, count(*) OVER (PARTITION BY person_id) AS total,
      row_number() OVER (PARTITION BY person_id ORDER BY day DESC,
        CASE state WHEN 'on_card' THEN 1 WHEN 'waiting' THEN 2 ELSE 3 END, seq DESC) AS pos
    FROM entry_t) WHERE pos <= 5""")
def _(spark, base):
    return sh.newest_first(entries(spark, base)).select(
        "person_id", "key", "state", F.col("pos").cast("bigint").alias("pos"), "cut")


@query("t4_who_texted_on_a_day", """
  SELECT CAST(w.day AS VARCHAR) AS day, w.key, w.state, w.summary, w.direction,
    coalesce(k.name, c.name, '…' || right(w.ident, 4)) AS name
  FROM (SELECT day, key, ident, person_id, direction, topic AS summary, 'on_card' AS state FROM stamped_t
    UNION ALL SELECT day, key, ident, person_id, direction, topic, 'waiting' FROM queue_t
      WHERE key NOT IN (SELECT key FROM stamped_t)
    UNION ALL SELECT day, key, ident, NULL, direction, NULL, 'held' FROM held_t) w
  LEFT JOIN cards k ON k.person_id = w.person_id LEFT JOIN contacts c ON c.ident = w.ident""")
def _(spark, base):
    t = state_tables(spark, base)
    rows = sh.who_on_day(t["stamped"], t["queue"], t["held"]).withColumn(
        "stored_name", F.lit(None).cast("string"))
    return rs.enrich_names(rows, adapt(spark, base, "cards"), adapt(spark, base, "contacts"),
                           mask_tail(F.col("ident"))).select(
        day_text(), "key", "state", "summary", "direction", F.col("shown_name").alias("name"))


@query("w7_character_budget", """
  SELECT ident, link, used, used <= 12000 AS fits FROM (
    SELECT e.ident, u.link, CAST(sum(length(t.shown)) OVER (PARTITION BY e.ident
        ORDER BY e.pos, u.pos, u.link ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
    FROM (SELECT ident, day, row_number() OVER (PARTITION BY ident ORDER BY day DESC) AS pos
          FROM person_day) e
    JOIN unit_link u ON u.ident = e.ident AND u.day = e.day
    JOIN (SELECT link, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE line_no > n - 40)
            AS shown FROM (SELECT *, count(*) OVER (PARTITION BY link) AS n FROM line)
          GROUP BY link) t ON t.link = u.link
    WHERE e.pos <= 5)""")
def _(spark, base):
    f = folded(spark, base)
    shown = tr.tails(f["prepared"], f["linked"], f["speakers"], f["contacts"], SETTINGS)
    days = f["person_days"].select(F.col("ident").alias("person_id"), "ident", "key", "day",
                                   F.lit("on_card").alias("state"), F.lit(0).alias("seq"))
    picked = sh.newest_first(days).select("person_id", "ident", "day", "pos")
    parts = (picked.join(f["unit_links"].select("ident", "day", F.col("pos").alias("link_pos"), "link"),
                         ["ident", "day"])
             .join(shown.select("link", "shown"), "link"))
    return sh.character_budget(parts).select("ident", "link", "used", "fits")


@query("t9_open_day_with", """
  SELECT p.ident, c.chat_rowid, c.messages, greatest(c.messages - 40, 0) AS cut
  FROM chat_day c JOIN seen_people p USING (chat_rowid, day)
  WHERE c.day = DATE '2024-01-30' AND NOT c.blocked""")
def _(spark, base):
    f = folded(spark, base)
    days, people = sh.open_day_with(f, date(2024, 1, 30))
    linked = tr.labels(days, f["voices"], f["contacts"])
    shown = tr.tails(f["prepared"].filter("day = DATE '2024-01-30'"), linked, f["speakers"],
                     f["contacts"], SETTINGS)
    return (people.join(days.select("chat_rowid", "messages"), "chat_rowid")
            .join(shown.select("chat_rowid", "cut"), "chat_rowid")
            .select("ident", "chat_rowid", "messages", "cut"))


