"""Maps the given tables onto the engine's input schemas.

Each adapter is one SQL text that reads the same in Spark and DuckDB, so the query and its
oracle start from the same rows; all logic beyond it is written twice, independently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from daybook.config import Settings
from daybook.sources.tables import table

SETTINGS = Settings(own_handles=("+15559999999", "me@example.com"),
                    never_ingest=("+15550000002",))

#: name -> (given tables or adapters it reads, SQL).  MICROS(x) is spelled per engine.
ADAPTERS: dict[str, tuple[tuple[str, ...], str]] = {
    "store_rows": (("events",), """
        SELECT event_id AS rowid, user_id,
          CASE WHEN user_id % 5 = 0 AND event_id % 4 <> 0 THEN user_id % 10
               ELSE 100 + user_id END AS chat_rowid,
          CASE WHEN user_id % 5 = 0 AND event_id % 4 <> 0 THEN 43 ELSE 45 END AS chat_style,
          CASE WHEN user_id % 10 = 0 AND event_id % 4 <> 0 THEN 'Group Zero' END AS chat_name,
          event_type IN ('purchase', 'signup') AS is_from_me,
          event_type = 'error' AND event_id % 10 = 0 AS no_handle,
          CASE WHEN user_id % 11 = 4 THEN concat('22', lpad(CAST(user_id AS STRING), 3, '0'))
               WHEN user_id % 7 = 3 THEN concat('User', CAST(user_id AS STRING), '@Example.com')
               WHEN user_id % 4 = 1 THEN concat('1 (555) ', lpad(CAST(user_id AS STRING), 7, '0'))
               WHEN user_id % 4 = 2 THEN concat('555-', lpad(CAST(user_id AS STRING), 7, '0'))
               ELSE concat('+1555', lpad(CAST(user_id AS STRING), 7, '0')) END AS user_handle,
          CASE WHEN event_id % 97 = 0 THEN ts - INTERVAL '2' DAY ELSE ts END AS sent_ntz,
          CASE WHEN event_id % 31 = 0 THEN 2000 ELSE 0 END AS associated_message_type,
          CASE WHEN event_id % 61 = 0 THEN 1 END AS item_type,
          CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 17 = 0 THEN ''
               WHEN event_id % 13 = 0 THEN concat('Your verification code is ',
                    lpad(CAST(event_id * 7919 % 1000000 AS STRING), 6, '0'))
               WHEN event_id % 29 = 0 THEN concat('the card ending in ',
                    lpad(CAST(event_id % 1000 AS STRING), 4, '0'))
               ELSE concat(event_type, ' item ', CAST(event_id % 500 AS STRING), ' for about ',
                    CAST(CAST(floor(value) AS INT) AS STRING), ' units') END AS text
        FROM events"""),
    "messages": (("store_rows",), """
        SELECT rowid, chat_rowid, chat_style, chat_name, chat_style = 43 AS is_group, is_from_me,
          CASE WHEN NOT no_handle THEN user_handle END AS handle_raw,
          CAST(sent_ntz AS TIMESTAMP) AS sent_at,
          (MICROS(sent_ntz) - 978307200000000) * 1000 AS date_raw, text
        FROM store_rows
        WHERE associated_message_type = 0 AND coalesce(item_type, 0) = 0"""),
    "store_message": (("store_rows",), """
        SELECT rowid,
          CASE WHEN rowid % 113 = 0 THEN NULL
               WHEN rowid % 101 = 0 THEN CAST(floor((MICROS(sent_ntz) - 978307200000000) / 1000000)
                                              AS BIGINT)
               ELSE (MICROS(sent_ntz) - 978307200000000) * 1000 END AS date_raw,
          is_from_me, CASE WHEN NOT no_handle THEN user_id + 1 END AS handle_id, text,
          associated_message_type, item_type,
          CASE WHEN rowid % 3 = 0 THEN 'E:Me@Example.com' WHEN rowid % 3 = 1
               THEN 'P:+1 (555) 999-9999' END AS account
        FROM store_rows"""),
    "store_handle": (("store_rows",), """
        SELECT DISTINCT user_id + 1 AS rowid, user_handle AS id FROM store_rows"""),
    "store_chat": (("store_rows",), """
        SELECT DISTINCT chat_rowid AS rowid, chat_style AS style,
          CASE WHEN chat_rowid % 10 = 3 THEN '  ' ELSE chat_name END AS display_name,
          CASE WHEN chat_rowid % 2 = 0 THEN 'E:me@example.com' ELSE 'P:5559999999' END
            AS account_login,
          CASE WHEN chat_rowid % 3 = 0 THEN '+15559999999' END AS last_addressed_handle
        FROM store_rows"""),
    "store_membership": (("store_rows",), """
        SELECT chat_rowid AS chat_id, rowid AS message_id FROM store_rows WHERE rowid % 89 <> 0
        UNION ALL
        SELECT 100 + user_id AS chat_id, rowid AS message_id FROM store_rows
        WHERE rowid % 83 = 0 AND chat_rowid <> 100 + user_id"""),
    "cards": (("customer",), """
        SELECT concat('prs_', lpad(CAST(c_custkey AS STRING), 8, '0')) AS person_id,
          c_name AS name,
          CASE WHEN c_custkey % 25 = 7 THEN concat('+555', lpad(CAST(c_custkey AS STRING), 7, '0'))
               WHEN c_custkey % 3 <> 0
               THEN concat('+1555', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS phone,
          CASE WHEN c_custkey % 20 = 1
               THEN concat('+1555', lpad(CAST(c_custkey + 1 AS STRING), 7, '0')) END AS shared_phone,
          CASE WHEN c_custkey % 7 = 3 AND c_custkey % 2 = 0
               THEN concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email
        FROM customer"""),
    "contacts": (("customer",), """
        SELECT concat(CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 THEN '+1555'
            ELSE '+1666' END, lpad(CAST(c_custkey AS STRING), 7, '0')) AS ident,
          CASE WHEN c_custkey % 6 = 0 THEN concat('Contact ', CAST(c_custkey AS STRING))
               ELSE c_name END AS name
        FROM customer"""),
    "raw_contacts": (("supplier", "customer"), """
        SELECT 0 AS store_rank, 0 AS kind_rank, s_suppkey AS row_no,
          CASE WHEN s_suppkey % 4 <> 0 THEN concat(' ', s_name, ' ') END AS first_name,
          CASE WHEN s_suppkey % 4 = 1 THEN 'Smith' END AS last_name,
          CASE WHEN s_suppkey % 8 <> 0 THEN concat('Org ', CAST(s_suppkey AS STRING)) END AS org,
          CASE WHEN s_suppkey % 9 = 0 THEN concat('bad', CAST(s_suppkey AS STRING), '@example.com')
               ELSE concat('(555) ', lpad(CAST(s_suppkey * 3 AS STRING), 7, '0')) END AS raw
        FROM supplier
        UNION ALL
        SELECT 1, 0, c_custkey, c_name, CAST(NULL AS STRING), CAST(NULL AS STRING),
          concat('1-555-', lpad(CAST(c_custkey AS STRING), 7, '0')) FROM customer
        UNION ALL
        SELECT 1, 1, c_custkey, c_name, '', concat('Firm ', CAST(c_custkey AS STRING)),
          CASE WHEN c_custkey % 5 = 0 THEN concat('no address ', CAST(c_custkey AS STRING))
               ELSE concat('User', CAST(c_custkey % 700 AS STRING), '@Example.com') END
        FROM customer"""),
    "card_text": (("customer",), """
        SELECT c_custkey AS doc_id, concat('# ', c_name, CHR(10), '## Notes', CHR(10),
          '- 2024-05-05 — conversation (mutual): decoy outside the section', CHR(10),
          '## Interactions', CHR(10), CHR(10),
          '- ', CAST(DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) AS STRING),
          ' — conversation (they_reached_out): Texts (', CAST(c_custkey % 9 AS STRING),
          '): hello (→ 2024/a-', CAST(c_custkey AS STRING), '.txt)', CHR(10),
          '- ', CAST(DATE '2024-06-01' + CAST(c_custkey % 100 AS INT) AS STRING),
          ' – conversation (i_reached_out) no link here', CHR(10),
          '  - 2024-07-07 - conversation(mutual):( → x y ) both ', CHR(10),
          '- 2024-07-08 — meeting (mutual): not a conversation', CHR(10),
          CASE WHEN c_custkey % 2 = 0 THEN concat('## Other', CHR(10)) ELSE '' END,
          '- 2024-09-09 — conversation (mutual): last one', CHR(10)) AS text
        FROM customer"""),
    "profile_text": (("supplier",), """
        SELECT s_suppkey AS doc_id, concat('# About', CHR(10), 'write to other@example.org', CHR(10),
          '**Email:** Me', CAST(s_suppkey AS STRING), '@Example.com, alt@example.com', CHR(10),
          '**Google:** me', CAST(s_suppkey AS STRING), '@example.com and g',
          CAST(s_suppkey AS STRING), '@example.org', CHR(10)) AS text FROM supplier"""),
    "proposals": (("orders",), """
        SELECT o_orderkey AS proposal_id,
          CASE WHEN o_orderkey % 2 = 0 THEN 'new_stub' ELSE 'add_identifier' END AS kind,
          CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending'
            ELSE 'dismissed' END AS status,
          CASE WHEN o_orderkey % 41 = 0 THEN '{broken' ELSE concat('{"kind":"phone","identifier":"',
            CASE WHEN o_custkey % 5 = 0 THEN '+1666' ELSE '+1555' END,
            lpad(CAST(o_custkey AS STRING), 7, '0'), '","name":"Name ',
            CAST(o_custkey AS STRING), '","person":"prs_',
            lpad(CAST(o_custkey AS STRING), 8, '0'), '"}') END AS payload,
          CAST(o_orderdate AS DATE) AS created
        FROM orders"""),
    "proposal_log": (("orders",), """
        SELECT o_orderkey * 2 AS log_id, o_orderkey AS proposal_id,
          CASE o_orderstatus WHEN 'P' THEN 'dismissed' ELSE 'accepted' END AS action,
          CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0
            THEN concat('created person customer-', CAST(o_custkey AS STRING), ' from new_stub')
            END AS detail,
          CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS created
        FROM orders WHERE o_orderstatus <> 'O'
        UNION ALL
        SELECT o_orderkey * 2 + 1, o_orderkey, 'dismissed', CAST(NULL AS STRING),
          CAST(o_orderdate AS DATE) + 9 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0"""),
    "ledger_days": (("orders",), """
        SELECT ident, day, concat(ident, '|day|', CAST(day AS STRING)) AS key, custkey, day_no,
          CASE WHEN (day_no + custkey) % 4 = 0 THEN 'queued' WHEN (day_no + custkey) % 4 = 1
            THEN 'held' WHEN (day_no + custkey) % 4 = 2 THEN 'stamped' ELSE 'unseen' END AS state,
          CASE WHEN custkey % 3 <> 0 THEN concat('prs_', lpad(CAST(custkey AS STRING), 8, '0'))
            END AS person_id,
          turns, concat('Texts (', CAST(turns AS STRING), '): about ', CAST(seq % 97 AS STRING))
            AS topic,
          CASE WHEN seq % 3 = 0 THEN 'mutual' WHEN seq % 3 = 1 THEN 'they_reached_out'
            ELSE 'i_reached_out' END AS direction,
          concat('2024/', CAST(day AS STRING), '-c', CAST(custkey AS STRING), '-1.txt') AS link,
          seq, CASE WHEN seq % 19 <> 0 THEN day + 1 END AS queued_at
        FROM (SELECT concat('+1555', lpad(CAST(custkey AS STRING), 7, '0')) AS ident, custkey, seq,
                turns, CAST(placed_at AS DATE) AS day,
                CAST(floor(MICROS(placed_at) / 86400000000) AS BIGINT) AS day_no
              FROM (SELECT o_custkey AS custkey, o_orderdate AS placed_at, min(o_orderkey) AS seq,
                      count(*) AS turns
                    FROM orders GROUP BY o_custkey, o_orderdate) AS o) AS d"""),
    "ledger_identifiers": (("customer", "orders", "supplier"), """
        SELECT concat(CASE WHEN custkey % 10 = 9 THEN '+1666' ELSE '+1555' END,
            lpad(CAST(custkey AS STRING), 7, '0')) AS ident,
          CASE k9 WHEN 0 THEN 'held' WHEN 1 THEN 'accepted' WHEN 2 THEN 'pending'
            WHEN 3 THEN 'attach_pending' WHEN 4 THEN 'dismissed' WHEN 5 THEN 'ambiguous'
            WHEN 6 THEN 'dismissed' WHEN 7 THEN 'attach_pending' ELSE 'accepted' END AS state,
          CASE k9 WHEN 0 THEN CASE WHEN custkey % 2 = 0 THEN 'new' ELSE 'cannot_attach' END
            WHEN 6 THEN 'wrong_match' END AS hold_reason,
          CASE WHEN k9 IN (2, 3) OR (k9 = 4 AND custkey % 2 = 0) THEN first_order END
            AS proposal_id,
          CASE WHEN k9 IN (1, 7, 8) THEN person_id END AS person_id,
          CASE k9 WHEN 1 THEN 'exact' WHEN 8 THEN 'suffix' END AS match_route,
          CASE WHEN k9 = 6 THEN person_id END AS match_person,
          CASE WHEN k9 = 8 AND custkey % 2 = 0 THEN person_id END AS match_confirmed,
          CASE WHEN custkey % 4 = 2 THEN concat('Customer#', lpad(CAST(custkey AS STRING), 9, '0'))
            WHEN custkey % 4 <> 0 THEN concat('Name ', CAST(custkey AS STRING)) END AS name
        FROM (SELECT c_custkey AS custkey, CAST(floor(c_custkey / 3) AS BIGINT) % 9 AS k9,
                concat('prs_', lpad(CAST(c_custkey AS STRING), 8, '0')) AS person_id, first_order
              FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order
                FROM orders GROUP BY o_custkey) AS o ON o_custkey = c_custkey) AS c
        UNION ALL
        SELECT concat('9', lpad(CAST(s_suppkey AS STRING), 15, '0')), 'held', 'new',
          CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
          CAST(NULL AS STRING), concat('Sender ', CAST(s_suppkey AS STRING)) FROM supplier"""),
    "claims": (("ledger_days",), """
        SELECT concat('claim-', CAST(day_no AS STRING)) AS claim_id, key,
          day + 1 + CAST(seq % 3 AS INT) AS lease_until
        FROM ledger_days WHERE day_no % 8 = 0
        UNION ALL
        SELECT concat('late-', CAST(day_no % 50 AS STRING)), key, day + 400 FROM ledger_days
        WHERE seq % 11 = 0"""),
    "planted": (("documents",), """
        SELECT doc_id, text AS body, doc_id % 16 AS shape,
          lpad(CAST(doc_id * 7919 % 1000000 AS STRING), 6, '0') AS six,
          concat('0', lpad(CAST(doc_id % 1000 AS STRING), 3, '0')) AS four FROM documents"""),
    "planted_tail": (("planted",), """
        SELECT doc_id, body,
          CASE shape WHEN 0 THEN 'Your verification code is ' WHEN 1 THEN 'your Acme code: '
            WHEN 2 THEN '' WHEN 3 THEN 'G-' WHEN 4 THEN 'Enter ' WHEN 5 THEN 'the password is '
            WHEN 6 THEN 'the code for the door is ' WHEN 7 THEN 'gate pin: '
            WHEN 8 THEN 'card ending in ' WHEN 9 THEN 'last four digits: ' WHEN 10 THEN '****'
            WHEN 11 THEN 'your zip code is 9' WHEN 12 THEN 'the lease ends in '
            WHEN 13 THEN 'card ' WHEN 14 THEN 'PIN is [redacted] and password is '
            ELSE 'pin ' END AS lead,
          CASE WHEN shape < 5 THEN six WHEN shape = 5 THEN concat('hunter', four)
            WHEN shape < 12 THEN four WHEN shape = 12 THEN '2026'
            WHEN shape = 13 THEN concat('4111-1111-1111-', four) WHEN shape = 14 THEN '"quo te"'
            ELSE '2026' END AS secret,
          CASE shape WHEN 2 THEN ' is your Acme verification code' WHEN 4 THEN ' to verify'
            WHEN 15 THEN ' budget' ELSE ' ok' END AS trail,
          CASE WHEN shape < 5 THEN 'otp_code' WHEN shape < 8 THEN 'password_or_pin'
            WHEN shape < 11 THEN 'card_tail' WHEN shape = 13 THEN 'long_digit_run'
            WHEN shape = 14 THEN 'password_or_pin' END AS rule
        FROM planted"""),
    "corpus": (("planted_tail",), """
        SELECT doc_id, concat(body, CHR(10), lead, secret, trail) AS text FROM planted_tail"""),
    "transcript_files": (("conversations",), """
        SELECT concat(CASE WHEN conv_id % 23 = 0 THEN '24' ELSE '2024' END, '/2024-01-',
            CASE WHEN conv_id % 29 = 0 THEN '42' ELSE
              lpad(CAST(1 + conv_id % 30 AS STRING), 2, '0') END, '-',
            CASE WHEN conv_id % 31 = 0 THEN 'Bad Slug' ELSE role END, '-',
            CAST(conv_id * 100 + turn AS STRING), '.txt') AS path,
          concat('09:15  ', role, ': ',
            CASE WHEN conv_id % 13 = 0 THEN 'Liked "it" ' WHEN conv_id % 13 = 1
              THEN 'Reacted :) to "it" ' ELSE '' END,
            replace(text, CHR(10), ' '),
            CASE WHEN conv_id % 17 = 0 THEN ' your code is 482193' ELSE '' END,
            CASE WHEN conv_id % 11 = 0 THEN CHR(13) ELSE '' END, CHR(10),
            CASE WHEN conv_id % 19 = 0 THEN concat('no clock here', CHR(10)) ELSE '' END,
            CASE WHEN turn = 0 THEN concat('09:16  Me: 4111111111111111: fine',
              CASE WHEN conv_id % 7 = 0 THEN CHR(12) ELSE '' END, CHR(10)) ELSE '' END,
            CASE WHEN conv_id % 37 = 0 THEN '09:17  Me: cut off' ELSE '' END) AS content
        FROM conversations"""),
    "summaries": (("conversations",), """
        SELECT conv_id * 100 + turn AS unit_no,
          CASE WHEN conv_id % 12 = 0 THEN NULL
            WHEN conv_id % 12 = 1 THEN concat('  ', CAST(turn AS STRING), ' agreed [mtg: x')
            WHEN conv_id % 12 = 2 THEN concat('we met — fine ', CAST(turn AS STRING))
            WHEN conv_id % 12 = 3 THEN concat('see (→ x ', CAST(turn AS STRING))
            WHEN conv_id % 12 = 4 THEN concat('Texts (3): ', replace(text, CHR(10), ' '))
            WHEN conv_id % 12 = 5 THEN '   '
            WHEN conv_id % 12 = 6 THEN concat('bad', CHR(7), 'bell')
            WHEN conv_id % 12 = 7 THEN replace(text, CHR(10), ' ')
            WHEN conv_id % 12 = 8 THEN replace(concat(text, text, text), CHR(10), ' ')
            WHEN conv_id % 12 = 9 THEN text
            ELSE concat('we said ', replace(text, CHR(10), ' ')) END AS summary,
          concat('Texts (', CAST(turn + 3 AS STRING), '): ',
            replace(text, CHR(10), ' ')) AS topic
        FROM conversations"""),
    "change_log": (("lineitem",), """
        SELECT seq, run, l_orderkey AS segment, op, CASE WHEN op IN ('claim', 'release_claim')
            THEN concat('claim-', CAST(CAST(floor(l_orderkey / 40) AS BIGINT) AS STRING))
            WHEN op IN ('set_identifier', 'release') THEN ident
            ELSE concat(ident, '|day|', CAST(day AS STRING)) END AS key, ident,
          concat('r', CAST(seq % 1000 AS STRING)) AS record
        FROM (SELECT seq, l_orderkey, l_orderkey % 50 AS run,
                concat('+1555', lpad(CAST(CAST(floor(l_orderkey / 20) AS BIGINT) AS STRING), 7, '0'))
                  AS ident, DATE '1995-01-01' + CAST(l_partkey % 20 AS INT) AS day,
                CASE (l_suppkey + l_linenumber) % 13 WHEN 0 THEN 'stamp_intent'
                  WHEN 1 THEN 'stamp_done' WHEN 2 THEN 'drop_intent' WHEN 3 THEN 'set_identifier'
                  WHEN 4 THEN 'hold' WHEN 5 THEN 'release' WHEN 6 THEN 'enqueue'
                  WHEN 7 THEN 'dequeue' WHEN 8 THEN 'refresh_links' WHEN 9 THEN 'claim'
                  WHEN 10 THEN 'release_claim' WHEN 11 THEN 'record_failure'
                  ELSE 'clear_failure' END AS op
              FROM (SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS seq,
                      l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey
                    FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey) AS l) AS o"""),
    "runs": (("lineitem",), """
        SELECT DISTINCT l_orderkey AS segment, l_orderkey % 50 AS run,
          (l_orderkey % 50 + CAST(floor(l_orderkey / 50) AS BIGINT)) % 7 <> 0 AS committed
        FROM lineitem"""),
    "links_seen": (("ledger_days",), """
        SELECT key, 0 AS pos, link, TRUE AS queued FROM ledger_days WHERE state = 'queued'
        UNION ALL
        SELECT key, 1, concat('2024/other-', CAST(seq % 3 AS STRING), '.txt'), TRUE
        FROM ledger_days WHERE state = 'queued' AND seq % 2 = 0
        UNION ALL
        SELECT key, 0, concat('2024/other-', CAST(seq % 4 AS STRING), '.txt'), FALSE
        FROM ledger_days WHERE seq % 3 = 0
        UNION ALL
        SELECT key, 1, link, FALSE FROM ledger_days WHERE seq % 3 <> 1"""),
    "failure_log": (("ledger_days",), """
        SELECT key, seq * 3 AS at_no, concat('detail ', CAST(seq % 5 AS STRING)) AS detail
        FROM ledger_days WHERE seq % 4 = 0
        UNION ALL
        SELECT key, seq * 3 + 1, 'the card was busy' FROM ledger_days WHERE seq % 12 = 0"""),
    "claim_docs": (("ledger_days",), """
        SELECT concat('claim-', CAST(seq AS STRING)) AS claim_id, seq,
          CASE WHEN seq % 11 = 0 THEN '{"format": 1, broken' ELSE concat(
            '{"format": ', CASE WHEN seq % 11 = 1 THEN '2' ELSE '1' END,
            ', "kind": "', CASE WHEN seq % 11 = 2 THEN 'other' ELSE 'summary-claim' END,
            '", "claim_id": "claim-', CAST(CASE WHEN seq % 11 = 3 THEN seq + 1 ELSE seq END AS STRING),
            '", "units": [{"id": "', CASE WHEN seq % 11 = 4 THEN 'x01' ELSE 'u01' END,
            '", "key": "', key, '", "day": "', CAST(day AS STRING), '", "links": ["', link, '"]}',
            CASE WHEN seq % 11 = 5 THEN ', {"id": "u01", "key": "k"}' ELSE '' END, ']',
            CASE WHEN seq % 11 = 6 THEN '' ELSE concat(', "summaries": {',
              CASE seq % 5 WHEN 0 THEN concat('"u01": "', said, '"')
                WHEN 1 THEN concat('"', key, '": "', said, '"')
                WHEN 2 THEN concat('"u01": "', said, '", "', key, '": "other words"')
                WHEN 4 THEN '"u77": "nobody asked"' ELSE '' END, '}') END, '}') END AS document
        FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN topic
                ELSE concat('we agreed on plan ', CAST(seq AS STRING)) END AS said
              FROM ledger_days) AS d"""),
    "holders": (("ledger_days",), """
        SELECT key, CASE WHEN seq % 7 = 0 THEN 'claim-other'
          ELSE concat('claim-', CAST(seq AS STRING)) END AS claim_id
        FROM ledger_days WHERE seq % 7 IN (0, 1)"""),
    "decisions": (("labels",), """
        SELECT doc_id + 1 AS label, 'accept' AS action,
          CASE WHEN doc_id % 6 = 0 THEN concat('Customer#', lpad(CAST(doc_id + 1 AS STRING), 9, '0'))
            WHEN doc_id % 3 = 0 THEN concat('Jane ', CAST(doc_id AS STRING)) END AS name
        FROM labels WHERE quality = 1
        UNION ALL
        SELECT doc_id + 1, 'dismiss', CAST(NULL AS STRING) FROM labels
        WHERE toxic = 1 OR (quality = 0 AND doc_id % 4 = 0)"""),
}


def _dialect(sql: str, engine: str) -> str:
    spelled = {"spark": r"unix_micros(CAST(\1 AS TIMESTAMP))", "duckdb": r"epoch_us(\1)"}[engine]
    return re.sub(r"MICROS\((\w+)\)", spelled, sql)


def adapt(spark: SparkSession, base: str, name: str) -> DataFrame:
    """An adapter, or a given table, as a DataFrame."""
    if name not in ADAPTERS:
        return table(spark, base, name)
    inputs, sql = ADAPTERS[name]
    text = _dialect(sql, "spark").replace("{", "{{").replace("}", "}}")
    for i in inputs:
        text = re.sub(rf"\b(FROM|JOIN) {i}\b", rf"\1 {{{i}}}", text)
    return spark.sql(text, **{i: adapt(spark, base, i) for i in inputs})


def adapter_sql(name: str) -> tuple[tuple[str, ...], str]:
    """Inputs and DuckDB text of an adapter."""
    inputs, sql = ADAPTERS[name]
    return inputs, _dialect(sql, "duckdb")
