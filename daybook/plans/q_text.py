"""Queries over text corpora: redaction, leaks, audits, scrubbing, summaries, keys, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybook.functions import text as X
from daybook.operators import audit as au
from daybook.operators import landing as la
from daybook.plans.adapters import adapt
from daybook.plans.registry import block, query
from daybook.plans.sqltext import sanitise

# Digit runs of the bodies, found without regular-expression look-around: the text is split
# on runs, so the characters around each run are the ends of its neighbouring pieces.
block("digit_run", """
  SELECT doc_id, i, piece, run, nxt, piece_start + length(piece) AS start FROM (
    SELECT doc_id, i, piece, run, lead(piece) OVER w AS nxt,
      coalesce(sum(length(piece) + coalesce(length(run), 0)) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece_start
    FROM (SELECT doc_id, unnest(range(len(pieces))) AS i, unnest(pieces) AS piece,
            unnest(list_resize(runs, len(pieces))) AS run
          FROM (SELECT doc_id, string_split_regex(body, '[0-9]+') AS pieces,
                  regexp_extract_all(body, '[0-9]+') AS runs FROM planted_tail))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i))""")
block("long_run", """
  SELECT * FROM digit_run WHERE length(run) BETWEEN 13 AND 19
    AND NOT regexp_matches(right(piece, 1), '[+0-9A-Za-z=/&?#._~-]')
    AND NOT regexp_matches(left(nxt, 1), '[A-Za-z0-9]')""")
block("span", """
  SELECT doc_id, 'long_digit_run' AS rule, CAST(start AS BIGINT) AS start, length(run) AS length
  FROM long_run
  UNION ALL
  SELECT doc_id, rule, length(body) + 1 + length(lead), length(secret) FROM planted_tail
  WHERE rule IS NOT NULL""")


@query("x7_redaction_spans", "SELECT doc_id, rule, start, length FROM span")
def _(spark, base):
    return au.corpus_spans(adapt(spark, base, "corpus"))


@query("x6_redact_corpus", """
  SELECT t.doc_id, b.body || chr(10) || t.lead ||
    CASE WHEN t.rule IS NULL THEN t.secret ELSE '[redacted]' END || t.trail AS text
  FROM planted_tail t JOIN (
    SELECT d.doc_id, string_agg(d.piece || coalesce(
      CASE WHEN l.i IS NOT NULL THEN '[redacted]' ELSE d.run END, ''), '' ORDER BY d.i) AS body
    FROM digit_run d LEFT JOIN long_run l ON l.doc_id = d.doc_id AND l.i = d.i
    GROUP BY d.doc_id) b ON b.doc_id = t.doc_id""")
def _(spark, base):
    return au.redact_corpus(adapt(spark, base, "corpus"))


@query("a10_redaction_rates", """
  SELECT rule, count(DISTINCT doc_id) AS bodies_hit, count(*) AS spans,
    count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS share
  FROM (SELECT doc_id, rule FROM span UNION ALL SELECT doc_id, '(any)' FROM span) GROUP BY rule""")
def _(spark, base):
    return au.redaction_rates(adapt(spark, base, "corpus"))


block("doc_line", """
  SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM corpus)""")


@query("a22_leak_scan", r"""
  SELECT DISTINCT w.doc_id, w.line, 'denylist: ' || t.term AS rule FROM (
    SELECT doc_id, line, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) AS word
    FROM doc_line) w JOIN (SELECT DISTINCT lang AS term FROM documents) t ON t.term = w.word
  UNION ALL
  SELECT doc_id, line, 'denylist: acme verification' FROM doc_line
  WHERE regexp_matches(lower(body), '(^|[^\p{L}\p{N}])acme verification($|[^\p{L}\p{N}])')
  UNION ALL
  SELECT doc_id, line, 'built-in: email address' FROM doc_line
  WHERE len(list_filter(regexp_extract_all(body,
    '[A-Za-z0-9._%+-]+@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})', 1),
    lambda d: NOT regexp_matches(lower(d), '^(.*\.)?example\.(com|org)$'))) > 0
  UNION ALL
  SELECT doc_id, line, 'built-in: US phone number' FROM doc_line
  WHERE len(list_filter(regexp_extract_all(' ' || regexp_replace(body, '([^0-9])', '\1\1', 'g') || ' ',
    '[^0-9](?:[+]*1(?:\s\s|\.\.|--)?)?(?:\(\()?[2-9][0-9]{2}(?:\)\))?(?:\s\s|\.\.|--)?[2-9][0-9]{2}(?:\s\s|\.\.|--)?[0-9]{4}[^0-9]'),
    lambda p: NOT regexp_matches(p, '555(\s\s|\.\.|--)?01[0-9]{2}[^0-9]$'))) > 0""")
def _(spark, base):
    docs = adapt(spark, base, "documents")
    terms = docs.select(F.col("lang").alias("term")).distinct().unionByName(
        spark.createDataFrame([("acme verification",)], "term string"))
    return au.leak_scan(adapt(spark, base, "corpus"), terms)


@query("a21_transcript_audit", r"""
  SELECT count(*) AS files,
    count(*) FILTER (WHERE regexp_matches(content, '(Liked|Loved|Emphasized|Laughed at|Disliked|Questioned) ["“]')
      OR regexp_matches(content, ': Reacted .{1,16} to ["“]')) AS reaction_body,
    count(*) FILTER (WHERE contains(content, chr(13))) AS carriage_return,
    count(*) FILTER (WHERE contains(content, chr(12))) AS other_break,
    count(*) FILTER (WHERE contains(content, 'no clock here') OR NOT ends_with(content, chr(10)))
      AS malformed_line,
    count(*) FILTER (WHERE NOT regexp_matches(path, '^2024/2024-01-(0[1-9]|[12][0-9]|3[01])-[a-z]+-[0-9]+\.txt$'))
      AS bad_name,
    count(*) FILTER (WHERE regexp_matches(content, '(^|[^+0-9A-Za-z=/&?#._~-])[0-9]{13,19}($|[^0-9A-Za-z])')
      OR contains(content, 'your code is 482193')) AS residual_secret
  FROM transcript_files""")
def _(spark, base):
    return au.transcript_audit(adapt(spark, base, "transcript_files"))


@query("a23_arrival_disorder", """
  SELECT count(*) AS rows, count(*) FILTER (WHERE at_micros < prev) AS before_previous,
    count(*) FILTER (WHERE at_micros < top) AS before_maximum
  FROM (SELECT at_micros, lag(at_micros) OVER (ORDER BY rowid) AS prev,
          max(at_micros) OVER (ORDER BY rowid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            AS top FROM qualified)""")
def _(spark, base):
    from daybook.functions.times import instant
    from daybook.sources.messages import qualifying
    rows = qualifying(adapt(spark, base, "store_message")).select(
        "rowid", F.unix_micros(instant(F.col("date_raw"))).alias("at"))
    return au.arrival_disorder(rows)


@query("x8_scrub_lines", rf"""
  SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE
    regexp_replace(CASE WHEN cut >= 150 THEN substr(t, 1, cut) ELSE substr(t, 1, 299) END,
      '[ ,;:.-]+$', '') || '…' END AS line
  FROM (SELECT doc_id, t, 299 - length(regexp_extract(substr(t, 1, 299), '[^ ]*$')) - 1 AS cut
    FROM (SELECT doc_id, {sanitise(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}\x{2028}\x{2029}]', ' ', 'g'), '[\p{L}\p{M}\p{Nd}\p{Pc}.+-]+@[\p{L}\p{M}\p{Nd}\p{Pc}-]+(\.[\p{L}\p{M}\p{Nd}\p{Pc}-]+)+', '[address]', 'g'), '[+][0-9]{7,15}|[0-9]{10,}', '[number]', 'g'), '\s*—\s*', '; ', 'g')")} AS t
      FROM corpus))""")
def _(spark, base):
    scrubbed = adapt(spark, base, "corpus").select("doc_id", X.scrub_line(F.col("text")).alias("t"))
    return scrubbed.select("doc_id", X.cap_line(F.col("t"), 300).alias("line"))


_WORDS = r"array_to_string(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+'), ' ')"


@query("p7_validate_summaries", rf"""
  SELECT unit_no, CASE WHEN summary IS NULL THEN 'not text'
    WHEN contains(summary, chr(10)) THEN 'line break'
    WHEN contains(summary, chr(7)) THEN 'control character' WHEN trim(summary) = '' THEN 'empty'
    WHEN length(trim(summary)) > 400 THEN 'too long' WHEN contains(summary, '—') THEN 'em dash'
    WHEN contains(summary, '(→') THEN 'link opening'
    WHEN contains(summary, '[mtg:') THEN 'meeting link'
    WHEN core = '' OR contains(' ' || line || ' ', ' ' || said || ' ')
      OR contains(' ' || line || ' ', ' ' || core || ' ') THEN 'restates the line' END AS problem
  FROM (SELECT *, trim(regexp_replace(said, '^(?:group texts(?: in)?|texts)(?: \d+)?(?: messages?)? ?', ''))
          AS core
        FROM (SELECT *, {_WORDS.format('summary')} AS said, {_WORDS.format('topic')} AS line
              FROM summaries))""")
def _(spark, base):
    return adapt(spark, base, "summaries").select(
        "unit_no", la.summary_problem(F.col("summary"), F.col("topic")).alias("problem"))


_LINES = """
  SELECT seq, CASE WHEN seq % 13 = 0 THEN '2024-02-30' WHEN seq % 13 = 1 THEN '24-2-3'
      ELSE CAST(day AS STRING) END AS day,
    CASE WHEN seq % 13 = 2 THEN concat(link, ')') WHEN seq % 13 = 3 THEN concat(link, CHR(10))
      WHEN seq % 13 <> 4 THEN link END AS link,
    CASE WHEN seq % 13 = 5 THEN concat(topic, ' ( → x') ELSE topic END AS topic
  FROM ledger_days"""


@query("p8_pointer_line_refusals", f"""
  SELECT seq, CASE WHEN seq % 13 = 1 THEN 'the day is not YYYY-MM-DD'
    WHEN seq % 13 = 0 THEN 'the day is not a calendar date' WHEN seq % 13 = 2 THEN 'the link holds '')'''
    WHEN seq % 13 = 3 THEN 'the link holds a line break'
    WHEN seq % 13 = 5 THEN 'the topic opens a link' END AS refusal FROM ({_LINES})""")
def _(spark, base):
    rows = spark.sql(_LINES.replace("FROM ledger_days", "FROM {d}"),
                     d=adapt(spark, base, "ledger_days"))
    return rows.select("seq", la.line_refusal(F.col("day"), F.col("topic"), F.col("link"))
                       .alias("refusal"))


@query("p13_mask_topics_and_links", """
  SELECT key, regexp_extract(topic, '^(Texts \\([0-9]+\\))', 1) || ': <' ||
      (length(topic) - strpos(topic, ':') - 1) || ' chars>' AS topic,
    '2024/' || CAST(day AS VARCHAR) || '-<' || (length(link) - 22) || ' chars>-1.txt' AS link
  FROM (SELECT key, topic, day, link FROM ledger_days)""")
def _(spark, base):
    return adapt(spark, base, "ledger_days").select(
        "key", X.mask_topic(F.col("topic")).alias("topic"), X.mask_link(F.col("link")).alias("link"))


_KEYS = """
  SELECT seq, CASE WHEN seq % 7 = 0 THEN concat(ident, '|week|', CAST(day AS STRING))
      WHEN seq % 7 = 1 THEN concat(ident, '|x|day|', CAST(day AS STRING))
      WHEN seq % 7 = 2 THEN concat(ident, '|day|2023-02-29') WHEN seq % 7 = 3 THEN ident
      ELSE key END AS key, ident, day FROM ledger_days"""


@query("x5_unit_keys", f"""
  SELECT seq, CASE WHEN seq % 7 IN (0, 2, 3) THEN NULL WHEN seq % 7 = 1 THEN ident || '|x'
      ELSE ident END AS ident,
    CASE WHEN seq % 7 NOT IN (0, 2, 3) THEN CAST(day AS VARCHAR) END AS day,
    ident || '|day|' || CAST(day AS VARCHAR) AS rebuilt FROM ({_KEYS})""")
def _(spark, base):
    rows = spark.sql(_KEYS.replace("FROM ledger_days", "FROM {d}"),
                     d=adapt(spark, base, "ledger_days"))
    return rows.select(
        "seq", X.key_ident(F.col("key")).alias("ident"),
        F.date_format(X.key_day(F.col("key")), "yyyy-MM-dd").alias("day"),
        X.unit_key(F.col("ident"), F.col("day")).alias("rebuilt"))


block("order_window", """
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day, lo FROM (
    SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)""")


def _order_days(spark, base):
    span = adapt(spark, base, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"),
                                            F.to_date(F.max("o_orderdate")).alias("hi"))
    return span.select("lo", F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day"))


@query("x11_day_window", """
  SELECT CAST(w.day AS VARCHAR) AS day, count(o.o_orderkey) AS entries
  FROM order_window w LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = w.day GROUP BY w.day""")
def _(spark, base):
    per_day = (adapt(spark, base, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
               .agg(F.count(F.lit(1)).alias("entries")))
    return _order_days(spark, base).join(per_day, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.coalesce("entries", F.lit(0)).alias("entries"))


@query("w10_tranches", """
  SELECT CAST(floor(datediff('day', CAST(lo AS DATE), day) / 30) AS BIGINT) AS tranche,
    CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day,
    count(*) AS days FROM order_window GROUP BY 1""")
def _(spark, base):
    from daybook.operators.backfill import tranches
    return tranches(_order_days(spark, base), 30).select(
        "tranche", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
        F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "days")


