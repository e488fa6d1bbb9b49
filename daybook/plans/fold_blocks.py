"""Oracle blocks of the fold: plain windows over the whole conversation-day."""

import re

from daybook.plans.registry import BLOCKS, block
from daybook.plans.sqltext import norm_handle, redacted, sanitise, shortcode, slug

OWN = "('+15559999999', 'me@example.com')"

block("canon", f"SELECT *, {norm_handle('handle_raw')} AS ident FROM messages")
block("prepared", f"""
  SELECT *, CASE WHEN is_from_me OR ident IN {OWN} THEN '(me)'
                 ELSE coalesce(ident, '(unknown)') END AS speaker,
    CASE WHEN ident NOT IN {OWN} THEN ident END AS participant,
    CAST(sent_at AS DATE) AS day, length({sanitise('text')}) AS chars
  FROM canon""")
block("flagged", """
  SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS opens,
    row_number() OVER w AS line_no
  FROM prepared WINDOW w AS (PARTITION BY chat_rowid, day ORDER BY sent_at, date_raw, rowid)""")
block("chat_day", f"""
  SELECT chat_rowid, day, CAST(sum(opens) AS BIGINT) AS turns, count(*) AS messages,
    CAST(sum(chars) AS BIGINT) AS chars, count(DISTINCT speaker) AS senders,
    min(sent_at) AS first_at,
    arg_min(is_group, line_no) AS is_group,
    max(CASE WHEN line_no = 1 THEN chat_name END) AS chat_name,
    CAST(coalesce(sum(opens) FILTER (WHERE speaker = '(me)'), 0) AS BIGINT) AS my_turns,
    min(sent_at) FILTER (WHERE speaker = '(me)') AS my_first,
    count(DISTINCT speaker) FILTER (WHERE speaker NOT IN ('(me)', '(unknown)')) AS speakers,
    count(DISTINCT speaker) FILTER (WHERE speaker NOT IN ('(me)', '(unknown)')
      AND NOT {shortcode('speaker')}) AS real_speakers,
    count(DISTINCT participant) AS counterparts,
    coalesce(bool_or(participant = '+15550000002'), false) AS blocked
  FROM flagged GROUP BY chat_rowid, day""")
block("kept", """
  SELECT * FROM chat_day WHERE NOT blocked AND (speakers = 0 OR real_speakers > 0)
    AND turns >= 2 AND senders >= 2 AND chars >= 20""")
block("spoke", """
  SELECT chat_rowid, day, speaker AS ident, CAST(sum(opens) AS BIGINT) AS their_turns,
    min(sent_at) AS their_first
  FROM flagged WHERE speaker NOT IN ('(me)', '(unknown)') GROUP BY ALL""")
block("spoken", "SELECT k.*, s.ident, s.their_turns, s.their_first "
                "FROM kept k JOIN spoke s USING (chat_rowid, day)")
block("ranked_spoken", """
  SELECT *, row_number() OVER (PARTITION BY ident, day
    ORDER BY their_turns DESC, is_group, first_at, chat_rowid) AS pos FROM spoken""")
block("person_day", f"""
  SELECT ident, day, ident || '|day|' || CAST(day AS VARCHAR) AS key, count(*) AS chats,
    bool_and(is_group) AS is_group, CAST(sum(turns) AS BIGINT) AS turns,
    CAST(sum(their_turns) AS BIGINT) AS their_turns, CAST(sum(my_turns) AS BIGINT) AS my_turns,
    CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(chars) AS BIGINT) AS chars,
    min(their_first) AS their_first, min(my_first) AS my_first,
    bool_or(NOT is_group AND my_turns > 0) AS outbound,
    max(CASE WHEN pos = 1 THEN chat_rowid END) AS primary_chat,
    CASE WHEN sum(my_turns) = 0 THEN 'they_reached_out'
      WHEN sum(their_turns) > 1 AND sum(my_turns) > 1 THEN 'mutual'
      WHEN min(their_first) <= min(my_first) THEN 'they_reached_out'
      ELSE 'i_reached_out' END AS direction
  FROM ranked_spoken WHERE NOT {shortcode('ident')} GROUP BY ident, day""")
block("seen_people", """
  SELECT chat_rowid, day, participant AS ident, min(line_no) AS seen,
    min(line_no) FILTER (WHERE speaker = participant) AS spoke
  FROM flagged WHERE participant IS NOT NULL GROUP BY ALL""")
block("best_label", f"""
  SELECT chat_rowid, day, arg_min(label, rank) AS label FROM (
    SELECT p.chat_rowid, p.day,
      CASE WHEN {sanitise('c.name')} <> '' THEN {sanitise('c.name')} ELSE p.ident END AS label,
        CAST(CASE WHEN {sanitise('c.name')} <> '' THEN 0 ELSE 2 END
        + CASE WHEN spoke IS NULL THEN 1 ELSE 0 END AS BIGINT) * 1000000000
        + coalesce(spoke, seen) AS rank
    FROM seen_people p LEFT JOIN contacts c ON c.ident = p.ident) GROUP BY ALL""")
block("linked", f"""
  SELECT *, CAST(year(day) AS VARCHAR) || '/' || CAST(day AS VARCHAR) || '-' || {slug('label')}
    || '-' || CAST(chat_rowid AS VARCHAR) || '.txt' AS link
  FROM (SELECT k.*, CASE WHEN k.is_group
          THEN coalesce(nullif({sanitise('k.chat_name')}, ''), 'group')
          ELSE coalesce(b.label, 'unknown') END AS label
        FROM kept k LEFT JOIN best_label b USING (chat_rowid, day))""")
block("line", f"""
  SELECT f.chat_rowid, f.day, l.link, f.line_no, f.sent_at, f.date_raw, f.rowid,
    CAST(floor(epoch_us(f.sent_at) / 300000000) AS BIGINT) AS slice,
    strftime(f.sent_at, '%H:%M') || '  ' || CASE WHEN f.speaker = '(me)' THEN 'Me'
      WHEN {sanitise('c.name')} <> '' THEN {sanitise('c.name')}
      ELSE coalesce(f.ident, 'Unknown') END || ': ' ||
      CASE WHEN f.text IS NULL THEN '[unreadable]'
           WHEN {redacted('f.text')} = '' THEN '[no words]' ELSE {redacted('f.text')} END AS line
  FROM flagged f JOIN linked l USING (chat_rowid, day) LEFT JOIN contacts c ON c.ident = f.speaker""")
block("opener", f"""
  SELECT chat_rowid, day, CASE WHEN length(body) > 80 THEN rtrim(substr(body, 1, 79)) || '…'
    ELSE body END AS opener
  FROM (SELECT chat_rowid, day, arg_min({redacted('text')}, line_no) AS body FROM flagged
        WHERE chars > 0 GROUP BY ALL)""")
block("unit_link", """
  SELECT r.ident, r.day, r.pos, l.link FROM ranked_spoken r JOIN linked l USING (chat_rowid, day)""")
block("unit", f"""
  SELECT p.key, p.ident, c.name, p.day, p.chats, l.link AS primary_link, p.direction, p.turns,
    p.their_turns, p.messages, p.outbound,
    replace(CASE WHEN l.is_group THEN 'Group texts in ' ||
        coalesce(nullif({sanitise('l.chat_name')}, ''), 'an unnamed group')
        || ' (' || l.messages || ' messages)'
      WHEN coalesce(o.opener, '') <> '' THEN 'Texts (' || l.messages || '): ' || o.opener
      ELSE 'Texts (' || l.messages || ')' END, '(→', '(->') AS topic
  FROM person_day p JOIN linked l ON l.chat_rowid = p.primary_chat AND l.day = p.day
  LEFT JOIN opener o ON o.chat_rowid = p.primary_chat AND o.day = p.day
  LEFT JOIN contacts c ON c.ident = p.ident""")


#: Everything above, in order; ``variant`` makes a second fold over other messages.
FOLD = ("canon", "prepared", "flagged", "chat_day", "kept", "spoke", "spoken", "ranked_spoken",
        "person_day")


def variant(prefix: str, messages: str) -> None:
    """Oracle blocks ``<prefix>canon`` … ``<prefix>person_day`` over another message relation."""
    for name in FOLD:
        sql = BLOCKS[name]
        for other in FOLD:
            sql = re.sub(rf"\b(FROM|JOIN) {other}\b", rf"\1 {prefix}{other}", sql)
        block(prefix + name, re.sub(r"\bFROM messages\b", f"FROM {messages}", sql))
