"""The ledger as keyed tables: change-log apply, set-difference joins, leases, roll-ups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daybook.functions.text import key_ident
from daybook.operators.shape import side_by_side

# --- fixed values: which operation touches which table ---------------------------------------
SETS = {"stamp_intent": ("stamped",), "stamp_done": ("stamped",),
        "set_identifier": ("identifiers",), "hold": ("held",), "enqueue": ("queue",),
        "refresh_links": ("queue",), "claim": ("claims",), "record_failure": ("failures",)}
REMOVES = {"drop_intent": ("stamped",), "stamp_done": ("queue", "failures"),
           "dequeue": ("queue",), "release_claim": ("claims",), "clear_failure": ("failures",)}
# --- end of fixed values -----------------------------------------------------------------------

#: The table that a released identifier is noted in while the log is applied.
RELEASED = "_released"


def apply_change_log(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Current state of the six keyed tables as (tbl, key, op, record).

    ``log`` and ``runs`` name a run's stretch of the log by ``segment``, the position where it
    begins: a run id used twice is two stretches, and one does not commit the other.
    The log is read once, with the commit flag looked up beside it.
    Operations of committed stretches count; of any other only stamp intents do.  Each
    operation becomes its effects, and the newest set and newest removal per key are two MAX
    aggregates that combine map-side, so a key written a billion times costs one row per task.
    """
    committed = runs.filter("committed").select("segment").distinct().withColumn(
        "_committed", F.lit(True))
    counted = log.join(committed, "segment", "left").filter(
        "_committed OR op = 'stamp_intent'")
    kinds = {op: [(t, True) for t in tables] for op, tables in SETS.items()}
    for op, tables in REMOVES.items():
        kinds.setdefault(op, []).extend((t, False) for t in tables)
    kinds["release"] = [(RELEASED, True)]
    effect = F.lit(None).cast("array<struct<tbl:string,is_set:boolean>>")
    for op, effects in kinds.items():
        effect = F.when(F.col("op") == op, F.array(*[
            F.struct(F.lit(t).alias("tbl"), F.lit(s).alias("is_set")) for t, s in effects])
        ).otherwise(effect)
    # An outer explode: before a plain one the optimizer would work the effects out to test them.
    rows = counted.select("seq", "op", "key", "record", F.explode_outer(effect).alias("e"))
    newest = rows.filter("e IS NOT NULL").groupBy("e.tbl", "key").agg(
        F.max(F.when(F.col("e.is_set"), F.struct("seq", "op", "record"))).alias("last_set"),
        F.max(F.when(~F.col("e.is_set"), F.col("seq"))).alias("last_remove"))
    # A release is a row of its own beside the held days of its identifier.
    owner = F.when(F.col("tbl") == "held", key_ident(F.col("key"))).otherwise(F.col("key"))
    freed = F.max(F.when(F.col("tbl") == RELEASED, F.col("last_set.seq"))).over(
        W.partitionBy("ident"))
    told = newest.withColumn("ident", owner).withColumn("released_at", freed)
    return told.filter(
        (F.col("tbl") != RELEASED) & F.col("last_set").isNotNull()
        & (F.col("last_remove").isNull() | (F.col("last_remove") < F.col("last_set.seq"))
           | ((F.col("tbl") == "stamped") & (F.col("last_set.op") == "stamp_done")))
        & ((F.col("tbl") != "held") | F.col("released_at").isNull()
           | (F.col("released_at") < F.col("last_set.seq")))).select(
        "tbl", "key", "last_set.op", "last_set.record")


def unseen_units(units: DataFrame, stamped: DataFrame, queue: DataFrame,
                 held: DataFrame) -> DataFrame:
    """Person-days not stamped, queued or held under their key."""
    known = stamped.select("key").unionByName(queue.select("key")).unionByName(held.select("key"))
    return units.join(known, "key", "left_anti")


def release_held(held: DataFrame, resolved: DataFrame, stamped: DataFrame, queue: DataFrame,
                 owners: DataFrame) -> DataFrame:
    """Held days of identifiers that now resolve, ready for the queue."""
    return (held.join(resolved.select("ident", F.col("person_id").alias("found_person")), "ident")
            .join(owners.select(F.col("person_id").alias("found_person")), "found_person",
                  "left_anti")
            .join(stamped.select("key").unionByName(queue.select("key")), "key", "left_anti"))


def live_claims(claims: DataFrame, now: date) -> DataFrame:
    """Per key the claim whose lease runs longest past ``now``."""
    live = claims.filter(F.col("lease_until") > F.lit(now))
    return live.groupBy("key").agg(F.min(F.struct(
        (-F.unix_date("lease_until")).alias("rank"), "claim_id", "lease_until")).alias("c")).select(
            "key", "c.claim_id", "c.lease_until")


def expired_claims(claims: DataFrame, now: date) -> DataFrame:
    """Claims none of whose leases is still live."""
    return (claims.groupBy("claim_id").agg(F.max("lease_until").alias("lease_until"))
            .filter(F.col("lease_until") <= F.lit(now)))


def settle_open_intents(intents: DataFrame, interactions: DataFrame) -> DataFrame:
    """Each open intent is done when its exact line is on the card, dropped when it is not."""
    written = interactions.select("person_id", "pointer").distinct().withColumn("_w", F.lit(True))
    return (intents.join(written, ["person_id", "pointer"], "left")
            .withColumn("settled", F.when(F.col("_w"), "done").otherwise("dropped")).drop("_w"))


def grow_links(current: DataFrame, seen: DataFrame, stamped: DataFrame) -> DataFrame:
    """Links of queued days only ever grow: order kept, new ones after, stamped days refused.

    Links are rows (key, pos, link), so a day with any number of links stays distributed.
    """
    last = current.groupBy("key").agg(F.max("pos").alias("last_pos"))
    fresh = (seen.groupBy("key", "link").agg(F.min("pos").alias("pos"))
             .join(current.select("key", "link"), ["key", "link"], "left_anti")
             .join(stamped.select("key"), "key", "left_anti")
             .join(last, "key")
             .select("key", (F.col("last_pos") + 1 + F.col("pos")).alias("pos"), "link",
                     F.lit(True).alias("is_new")))
    return current.select("key", "pos", "link", F.lit(False).alias("is_new")).unionByName(fresh)


def identifier_rollup(batch: DataFrame, current: DataFrame, seen: DataFrame) -> DataFrame:
    """Identifier rows after a batch: first/last day widened, day count grown by NEW days only."""
    per = (batch.join(seen.select("key").distinct().withColumn("_s", F.lit(True)), "key", "left")
           .groupBy("ident").agg(F.min("day").alias("b_first"), F.max("day").alias("b_last"),
                                 F.count_if(F.col("_s").isNull()).alias("b_new")))
    return per.join(current, "ident", "full_outer").select(
        "ident", F.least("b_first", "first_seen").alias("first_seen"),
        F.greatest("b_last", "last_seen").alias("last_seen"),
        (F.coalesce("days", F.lit(0)) + F.coalesce("b_new", F.lit(0))).alias("days"))


def filed_and_waiting(stamped: DataFrame, queue: DataFrame) -> DataFrame:
    """Per identifier: days on a card and days waiting."""
    marks = (stamped.select(key_ident(F.col("key")).alias("ident"), F.lit(1).alias("f"),
                            F.lit(0).alias("w"))
             .unionByName(queue.select("ident", F.lit(0).alias("f"), F.lit(1).alias("w"))))
    return marks.filter("ident IS NOT NULL").groupBy("ident").agg(
        F.sum("f").alias("filed"), F.sum("w").alias("waiting"))


def failure_counts(log: DataFrame, stamped: DataFrame) -> DataFrame:
    """Attempts per key with the latest detail; a key that has landed is cleared."""
    return (log.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"),
                                   F.max(F.struct("at_no", "detail")).alias("l"))
            .join(stamped.select("key"), "key", "left_anti")
            .select("key", "attempts", "l.detail"))


def waiting_counts(identifiers: DataFrame) -> DataFrame:
    """How many numbers wait on the people queue, and how many on the review list."""
    attach = F.col("state") == "attach_pending"
    has = F.col("proposal_id").isNotNull()
    return identifiers.agg(
        F.count_if((F.col("state") == "pending") | (attach & has)).alias("on_queue"),
        F.count_if(F.col("state").isin("held", "ambiguous") | (attach & ~has)).alias("on_review"))


def ledger_status(days: DataFrame, identifiers: DataFrame, claims: DataFrame,
                  failures: DataFrame, now: date) -> DataFrame:
    """One row of counts over the state tables; ``days`` carries (key, ident, day, state)."""
    live = live_claims(claims, now).select("key").withColumn("_live", F.lit(True))
    queued = F.col("state") == "queued"
    counted = days.join(live, "key", "left").agg(
        F.count_if(F.col("state") == "stamped").alias("stamped"),
        F.count_if(F.col("state") == "held").alias("held_units"),
        F.count_if(queued).alias("queued"),
        F.min(F.when(queued, F.col("day"))).alias("oldest_day"),
        F.count_if(queued & F.col("_live").isNull()).alias("unclaimed"))
    held_ids = (days.filter("state = 'held'").groupBy("ident").agg(F.count(F.lit(1)).alias("n"))
                .agg(F.count(F.lit(1)).alias("held_identifiers")))
    states = identifiers.agg(
        F.count(F.lit(1)).alias("identifiers"),
        *[F.count_if(F.col("state") == s).alias(f"state_{s}") for s in
          ("held", "accepted", "pending", "attach_pending", "dismissed", "ambiguous")])
    holders = (live_claims(claims, now).join(days.filter(queued).select("key"), "key", "left_semi")
               .select("claim_id").distinct().agg(F.count(F.lit(1)).alias("live_claims")))
    failing = failures.agg(F.count(F.lit(1)).alias("failures"))
    return side_by_side(counted, held_ids, states, holders, failing)
