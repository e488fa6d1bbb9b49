"""Corpus jobs: redaction counts, leak scan, transcript audit, arrival disorder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.redaction import RULES, redact, redaction_spans, rule_name
from daybook.operators.shape import side_by_side
from daybook.session import durable

# --- fixed values: audit patterns --------------------------------------------------------
REACTIONS = ('Liked "', 'Loved "', 'Emphasized "', 'Laughed at "', 'Disliked "', 'Questioned "',
             "Liked “", "Loved “", "Emphasized “", "Laughed at “", "Disliked “", "Questioned “",
             "Gefällt", "ein Herz")
DENIED = "denylist: "
EMAIL_RULE = "built-in: email address"
HOME_RULE = "built-in: home-folder path"
PHONE_RULE = "built-in: US phone number"
REACTED = r"^Reacted .{1,16} to [\"“]"
OTHER_BREAKS = r"[\x0b\x0c\x1c\x1d\x1e\x85  ]"
LINE_SHAPE = r"^(\d{2}:\d{2})  (.+?): (.*)$"
FILE_SHAPE = r"^(\d{4})/(\d{4})-(\d{2})-(\d{2})-([a-z0-9]+(?:-[a-z0-9]+)*)-(\d+)\.txt$"
ALLOWED_DOMAINS = r"(?i)^(?:.*\.)?example\.(?:com|org)$"
EMAIL = (r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
         r"(?![A-Za-z0-9-])")
HOME_PATH = r"(?i)(?<![A-Za-z0-9_])[/\\](?:Users|home)[/\\]([A-Za-z0-9._-]+)"
HOME_PLACEHOLDERS = ("you", "yourname", "your-name", "your_name", "username", "example", "shared")
HOME_SIGN = r"(?i)[/\\](?:Users|home)[/\\]"
TERM_LETTER, TERM_SYMBOL = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\s]"
US_PHONE = (r"(?<!\d)(?:\+?1[\s.-]?)?\(?([2-9]\d{2})\)?[\s.-]?([2-9]\d{2})[\s.-]?(\d{4})(?!\d)")
# --- end of fixed values -----------------------------------------------------------------

TERM_WORD = f"{TERM_LETTER}+"
#: Bytes of deny terms that are sent to every task at once.
INDEX_BYTES = 32_000_000


def corpus_spans(corpus: DataFrame) -> DataFrame:
    """(doc_id, rule, start, length) of every redaction span, one row each."""
    return (corpus
            .select("doc_id", F.explode(redaction_spans("text")).alias("s"))
            .select("doc_id", rule_name(F.col("s.rule_no")).alias("rule"),
                    F.col("s.start").alias("start"), (-F.col("s.neg_len")).alias("length")))


def redact_corpus(corpus: DataFrame) -> DataFrame:
    """The corpus with every secret-shaped span replaced; a map-only job."""
    return corpus.select("doc_id", redact("text").alias("text"))


def redaction_rates(corpus: DataFrame) -> DataFrame:
    """Per rule (and for any rule): bodies hit, spans, share of all bodies.

    Every body yields one small row per rule, so the total comes out of the same pass and the
    counts combine map-side; no distinct over ids is needed.
    """
    def of(no: int) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["rule_no"] == no))

    per_rule = [F.struct(F.lit(rule).alias("rule"), of(no).alias("n"))
                for no, rule in enumerate(RULES)]
    anything = F.struct(F.lit("(any)").alias("rule"), F.size("spans").alias("n"))
    rows = (corpus.select(redaction_spans("text").alias("spans"))
            .select(F.explode(F.array(*per_rule, anything)).alias("r")))
    return (rows.groupBy("r.rule").agg(
        F.count_if(F.col("r.n") > 0).alias("bodies_hit"), F.sum("r.n").alias("spans"),
        (F.count_if(F.col("r.n") > 0) / F.count(F.lit(1))).alias("share"))
        .filter("bodies_hit > 0"))


def _term_index(terms: DataFrame) -> DataFrame:
    """(term, word, plain): every deny term once, met through one word of it, its anchor.

    The anchor is the word that fewest terms hold, then the longest, then the first by name; a term
    without a word is met through its first symbol.  ``plain`` terms are nothing but their anchor.
    """
    clean = terms.select(F.lower(F.trim("term")).alias("term")).filter("term <> ''").distinct()
    words = F.array_distinct(F.regexp_extract_all("term", F.lit(TERM_WORD), 0))
    held = clean.select("term", F.explode_outer(words).alias("word"))
    held = held.withColumn("word", F.coalesce("word", F.substring("term", 1, 1)))
    shared = held.groupBy("word").agg(F.count(F.lit(1)).alias("holders"))
    rarest = F.min(F.struct("holders", (-F.length("word")).alias("less"), "word"))
    return (held.join(shared, "word").groupBy("term").agg(rarest.alias("anchor"))
            .select("term", "anchor.word",
                    ((F.col("term") == F.col("anchor.word"))
                     & F.col("term").rlike(f"^{TERM_WORD}$")).alias("plain")))


def _broken_rules(lines: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """(doc_id, line, rule) of the built-in rules; a line without their signs is passed over."""
    def every(pattern: str, group: int) -> F.Column:
        return F.regexp_extract_all("body", F.lit(pattern), group)

    known = [a.lower() for a in allowed]
    email = F.exists(every(EMAIL, 0), lambda a: ~F.lower(a).isin(*known)
                     & ~F.substring_index(a, "@", -1).rlike(ALLOWED_DOMAINS))
    home = F.exists(every(HOME_PATH, 1), lambda n: ~F.lower(n).isin(*HOME_PLACEHOLDERS))
    phone = F.exists(F.arrays_zip(every(US_PHONE, 2).alias("mid"), every(US_PHONE, 3).alias("end")),
                     lambda n: ~((n["mid"] == "555") & n["end"].startswith("01")))
    rule = F.explode(F.array_compact(F.array(
        F.when(F.col("body").contains("@") & email, EMAIL_RULE),
        F.when(F.col("body").rlike(HOME_SIGN) & home, HOME_RULE),
        F.when(F.col("body").rlike("[0-9]{4}") & phone, PHONE_RULE))))
    return (lines.filter(F.col("body").rlike(f"@|[0-9]{{4}}|{HOME_SIGN}"))
            .select("doc_id", "line", rule.alias("rule")))


def leak_scan(documents: DataFrame, terms: DataFrame, allowed: Sequence[str] = (),
              index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, line, rule) for every line holding something that must not leave.

    The deny terms are an index by anchor word.  A line is asked for its distinct words where it is
    read: a term that is one word is then decided, any other is looked for in the line at hand.  So
    neither texts nor words are ever shuffled, however common a word is, and the text itself is
    never returned.  The index is sent to the tasks in slices of at most ``index_bytes``; if it
    takes more than one, terms whose anchor occurs in no document are left out first.

    ``allowed`` are single addresses that may leave, whatever their domain.  A list without any term
    is refused; a NULL document or a blank term gives no row.
    """
    index = durable(_term_index(terms))
    told = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term") + 64).alias("bytes"),
                     F.max(~F.col("word").rlike(TERM_WORD)).alias("symbols")).first()
    if not told["n"]:
        raise ValueError("the list of terms is empty")
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    token = f"{TERM_WORD}|{TERM_SYMBOL}" if told["symbols"] else TERM_WORD
    folded = lines.select("doc_id", "line", F.lower("body").alias("body"))
    words = folded.select("doc_id", "line", "body", F.array_distinct(
        F.regexp_extract_all("body", F.lit(token), 0)).alias("words"))
    size = told["bytes"]
    if size > index_bytes:
        seen = words.select(F.explode("words").alias("word")).distinct()
        index = durable(index.join(seen, "word", "left_semi"))
        size = index.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    # An outer explode, because the optimizer would take the words twice to test a plain one first.
    asked = words.select("doc_id", "line", "body", F.explode_outer("words").alias("word"))
    quoted = F.regexp_replace("term", f"({TERM_SYMBOL})", r"\\$1")
    whole = F.col("body").contains(F.col("term")) & F.rlike("body", F.concat(
        F.lit(f"(?<!{TERM_LETTER})"), quoted, F.lit(f"(?!{TERM_LETTER})")))
    hits, slices = _broken_rules(lines, allowed), -(-size // index_bytes)
    for i in range(slices):
        mine = index.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == i)
        met = asked.join(F.broadcast(mine), "word").filter(F.col("plain") | whole)
        hits = hits.union(met.select(
            "doc_id", "line", F.concat(F.lit(DENIED), "term").alias("rule")))
    return hits


def transcript_audit(files: DataFrame) -> DataFrame:
    """Per invariant, how many transcripts break it."""
    named = F.regexp_extract("path", FILE_SHAPE, 2)
    day = F.concat_ws("-", named, F.regexp_extract("path", FILE_SHAPE, 3),
                      F.regexp_extract("path", FILE_SHAPE, 4))
    good_name = (F.col("path").rlike(FILE_SHAPE)
                 & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
                 & (F.regexp_extract("path", FILE_SHAPE, 1) == named)
                 & (F.length(F.regexp_extract("path", FILE_SHAPE, 5)) <= 60))
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")
    bodies = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\r+\z", "")),
                      lambda x: x.rlike(LINE_SHAPE))
    flat = (files.select(
        "path", "content", lines.alias("lines"),
        F.transform(bodies, lambda x: F.regexp_extract(x, LINE_SHAPE, 3)).alias("bodies"),
        good_name.alias("good_name")))
    secret = (flat.select("path", F.explode("bodies").alias("body"))
              .filter(F.size(redaction_spans("body")) > 0).select("path").distinct()
              .agg(F.count(F.lit(1)).alias("residual_secret")))

    def reaction(body: F.Column) -> F.Column:
        hit = body.rlike(REACTED)
        for marker in REACTIONS:
            hit = hit | body.contains(marker)
        return hit

    rest = flat.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.exists("bodies", reaction)).alias("reaction_body"),
        F.count_if(F.col("content").contains("\r")).alias("carriage_return"),
        F.count_if(F.col("content").rlike(OTHER_BREAKS)).alias("other_break"),
        F.count_if(~F.col("content").endswith("\n")
                   | F.exists("lines", lambda x: ~F.regexp_replace(x, r"\r+\z", "")
                              .rlike(LINE_SHAPE))).alias("malformed_line"),
        F.count_if(~F.col("good_name")).alias("bad_name"))
    return side_by_side(rest, secret)


def arrival_disorder(rows: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """Share of rows dated before their predecessor, and before the running maximum.

    ``rows`` has (rowid, at).  Row ids are cut into buckets, ordered inside each, and what a
    bucket needs from all earlier ones (last date, highest date) is carried over two further
    levels, so no window ever spans the whole table.
    """
    b = rows.withColumn("b1", F.floor(F.col("rowid") / bucket).cast("bigint")).withColumn(
        "b2", F.floor(F.col("b1") / bucket).cast("bigint"))
    inside = W.partitionBy("b2", "b1").orderBy("rowid")
    flagged = (b.withColumn("prev", F.lag("at").over(inside))
               .withColumn("top", F.max("at").over(inside.rowsBetween(W.unboundedPreceding, -1))))
    per_bucket = b.groupBy("b2", "b1").agg(F.max(F.struct("rowid", "at")).alias("tail"),
                                           F.max("at").alias("high"))
    per_super = per_bucket.groupBy("b2").agg(F.max("tail").alias("tail"), F.max("high").alias("high"))
    over_super = W.orderBy("b2").rowsBetween(W.unboundedPreceding, -1)
    carried = per_super.select("b2", F.last("tail.at").over(over_super).alias("far_tail"),
                               F.max("high").over(over_super).alias("far_high"))
    over_bucket = W.partitionBy("b2").orderBy("b1").rowsBetween(W.unboundedPreceding, -1)
    near = (per_bucket.select("b2", "b1", F.last("tail.at").over(over_bucket).alias("near_tail"),
                              F.max("high").over(over_bucket).alias("near_high"))
            .join(carried, "b2")
            .select("b2", "b1", F.coalesce("near_tail", "far_tail").alias("tail"),
                    F.greatest("near_high", "far_high").alias("high")))
    prev, top = F.coalesce("prev", "tail"), F.greatest("top", "high")
    return flagged.join(near, ["b2", "b1"]).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("at") < prev).alias("before_previous"),
        F.count_if(F.col("at") < top).alias("before_maximum"))
