"""The identifier state machine and the review list, table to table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.config import RECENT_DAYS, REOPENED, listing
from daybook.functions.text import valid_identifier
from daybook.operators.ranking import number_rows
from daybook.operators.resolve import name_matches
from daybook.operators.shape import look_up
from daybook.session import durable

# --- fixed values: section order and the created-person log line ---------------------------------
SECTIONS = ("attach", "known", "new", "bare", "not_a_number", "ambiguous")
CREATED = r"^created person ([a-z0-9][a-z0-9-]*) from new_stub$"
# --- end of fixed values -----------------------------------------------------------------------------

#: Why every step of a batch is refused whose list is not the one shown.
LIST_CHANGED = "the list has changed"


def dismissal_days(log: DataFrame) -> DataFrame:
    """The latest logged dismissal day of each proposal."""
    return (log.filter("action = 'dismissed'").groupBy("proposal_id")
            .agg(F.max("created").alias("dismissed_on")))


def reopen_justified(evidence: DataFrame, proposals: DataFrame, log: DataFrame) -> DataFrame:
    """Dismissed proposals whose identifier has evidence STRICTLY after the dismissal day."""
    return (proposals.filter("status = 'dismissed'").join(dismissal_days(log), "proposal_id")
            .join(evidence.select("ident", "evidence"), "ident")
            .filter(F.col("evidence") > F.col("dismissed_on")))


def reopen(proposals: DataFrame, justified: DataFrame, today: date) -> tuple[DataFrame, DataFrame]:
    """Proposals with the justified ones pending again, and the log rows that say so."""
    back = justified.select("proposal_id").withColumn("_r", F.lit(True))
    changed = (proposals.join(back, "proposal_id", "left")
               .withColumn("status", F.when(F.col("_r"), "pending").otherwise(F.col("status")))
               .drop("_r"))
    rows = justified.select("proposal_id", F.lit("pending").alias("action"),
                            F.lit(REOPENED).alias("detail"),
                            F.lit(today).alias("created"))
    return changed, rows


def accepted_persons(proposals: DataFrame, log: DataFrame, slugs: DataFrame) -> DataFrame:
    """The person each accepted new-person proposal created, read from its newest log line."""
    newest = (log.filter("action = 'accepted'").groupBy("proposal_id")
              .agg(F.max(F.struct("log_id", "detail")).alias("l"))
              .select("proposal_id", F.regexp_extract("l.detail", CREATED, 1).alias("slug")))
    return (proposals.filter("kind = 'new_stub' AND status = 'accepted'").select("proposal_id")
            .join(newest, "proposal_id").join(slugs, "slug")
            .select("proposal_id", F.col("person_id").alias("new_person")))


def _case(rules: list[tuple[Column, Column]]) -> Column:
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def _decision(outcome: str, reason: Column | str, state: Column | str | None = None,
              proposal: Column | None = None) -> Column:
    def col(x: Column | str | None, kind: str = "string") -> Column:
        return x.cast(kind) if isinstance(x, Column) else F.lit(x).cast(kind)

    return F.struct(F.lit(outcome).alias("outcome"), col(reason).alias("reason"),
                    col(state).alias("new_state"), col(proposal, "bigint").alias("new_proposal"))


def decision_inputs(resolved: DataFrame, identifiers: DataFrame, proposals: DataFrame,
                    newest: DataFrame, log: DataFrame, slugs: DataFrame, owners: DataFrame,
                    cards: DataFrame) -> DataFrame:
    """Everything the decision looks at, one row per identifier, by equi-joins on unique keys."""
    record = identifiers.select(
        "ident", "state", "hold_reason", "proposal_id", F.col("person_id").alias("record_person"),
        "match_person", F.col("name").alias("record_name"))
    states = proposals.select("proposal_id", F.col("status").alias("proposal_state"))
    dismissed = newest.filter("status = 'dismissed'").select(
        "ident", F.col("proposal_id").alias("dismissed_id"))
    pending = newest.filter("status = 'pending'").select(
        "ident", F.col("proposal_id").alias("pending_id"))
    days = dismissal_days(log)
    made = accepted_persons(proposals, log, slugs)
    rec_named = name_matches(record.select("ident", F.col("record_name").alias("name")), cards)
    single = rec_named.filter("candidates = 1").select("ident", F.col("lo").alias("record_attach"))
    out = (resolved.join(record, "ident", "left").join(dismissed, "ident", "left")
           .join(pending, "ident", "left").join(single, "ident", "left"))
    # All of these keys are mostly NULL, so the rows without one are spread by identifier.
    for table, key in (
            (states, "proposal_id"), (made, "proposal_id"),
            (days.select("proposal_id", F.col("dismissed_on").alias("own_day")), "proposal_id"),
            (days.select(F.col("proposal_id").alias("dismissed_id"),
                         F.col("dismissed_on").alias("other_day")), "dismissed_id"),
            (owners.select("person_id", F.lit(True).alias("is_owner")), "person_id"),
            (owners.select(F.col("person_id").alias("new_person"),
                           F.lit(True).alias("new_is_owner")), "new_person")):
        out = look_up(out, table, key, "ident")
    return out


def decide_identifiers(inputs: DataFrame, today: date, *, emit: bool = False,
                       reopen_dismissed: bool = False) -> DataFrame:
    """One decision per identifier; the first rule that applies wins."""
    c = F.col
    state, proposal = c("state"), c("proposal_id")
    resolved = c("status") == "resolved"
    wrong = ((state == "dismissed") & (c("hold_reason") == "wrong_match")
             & (c("match_person") == c("person_id")))
    linked = state.isin("pending", "attach_pending") & proposal.isNotNull()

    def after_no(pid: Column, day: Column) -> list[tuple[Column, Column]]:
        again = F.lit(reopen_dismissed) & c("evidence").isNotNull() & (c("evidence") > day)
        return [(again, _decision("hold", "reopened", "pending", pid)),
                (F.lit(True), _decision("hold", "dismissed", "dismissed", pid))]

    def gated(condition: Column, rules: list[tuple[Column, Column]]) -> list:
        return [(condition & inner, value) for inner, value in rules]

    names_new = (c("record_attach") == c("new_person")) | (c("attach_to") == c("new_person"))
    follow = gated(linked & (c("proposal_state") == "accepted") & (state == "pending"), [
        (c("new_person").isNull(), _decision("hold", "accepted_unknown", "pending", proposal)),
        (F.coalesce(c("new_is_owner"), F.lit(False)), _decision("owner", "owner")),
        (F.coalesce(names_new, F.lit(False)),
         _decision("raise", "attach_pending", "attach_pending", proposal)),
        (F.lit(True), _decision("hold", "accepted_unattached", "pending", proposal))])
    recent = c("newest") >= F.date_sub(F.lit(today), RECENT_DAYS)
    rules = [
        (resolved & F.coalesce(wrong, F.lit(False)), _decision("hold", "wrong_match", state, proposal)),
        (resolved & F.coalesce(c("is_owner"), F.lit(False)), _decision("owner", "owner")),
        (resolved, _decision("queue", c("route"), "accepted", proposal)),
        ((state == "dismissed") & proposal.isNull(), _decision("hold", "dismissed", state)),
        ((state == "attach_pending") & proposal.isNull() & c("record_person").isNotNull(),
         _decision("hold", "attach_pending", state)),
        (c("status") == "ambiguous", _decision("hold", "ambiguous", "ambiguous")),
        (c("status") == "unresolved", _decision("hold", "unresolved", "held")),
        (linked & (c("proposal_state") == "pending"), _decision("hold", state, state, proposal)),
        *follow,
        (linked & (c("proposal_state") == "accepted"),
         _decision("hold", "cannot_attach", "held", proposal)),
        *gated((linked | ((state == "dismissed") & proposal.isNotNull()))
               & (c("proposal_state") == "dismissed"), after_no(proposal, c("own_day"))),
        (state.isin("held", "ambiguous"),
         _decision("hold", F.coalesce(c("hold_reason"), state), state, proposal)),
        *gated(c("dismissed_id").isNotNull(), after_no(c("dismissed_id"), c("other_day"))),
        (c("pending_id").isNotNull(), _decision("hold", "pending", "pending", c("pending_id"))),
        *([(recent, _decision("raise", c("proposal_kind"), "pending"))] if emit else []),
        (F.lit(True), _decision("hold", "new", "held")),
    ]
    return inputs.withColumn("ruling", _case(rules)).select(
        "ident", "person_id", "route", "new_person",
        *[F.col("ruling")[n].alias(n) for n in ("outcome", "reason", "new_state", "new_proposal")])


def follow_through(decided: DataFrame) -> DataFrame:
    """Attach proposals to raise for numbers whose accepted card was made without them."""
    return decided.filter("outcome = 'raise' AND reason = 'attach_pending'").select(
        "ident", F.lit("add_identifier").alias("kind"), F.col("new_person").alias("person_id"))


def raise_proposals(decided: DataFrame, proposals: DataFrame) -> DataFrame:
    """New proposals for first sightings, none where one is already pending or dismissed."""
    known = proposals.filter("status IN ('pending', 'dismissed')").select("ident")
    return (decided.filter("outcome = 'raise' AND reason <> 'attach_pending'")
            .join(known, "ident", "left_anti").select("ident", F.col("reason").alias("kind")))


# --- the review list -----------------------------------------------------------------------------


def classify_review(inputs: DataFrame, newest: DataFrame, held: DataFrame) -> DataFrame:
    """Each identifier that is not settled: its section, or why it is not listed."""
    c = F.col
    days = held.groupBy("ident").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first"),
                                     F.max("day").alias("last"))
    waiting = newest.filter("status = 'pending'").select(
        "ident", c("kind").alias("pending_kind"), c("proposal_name").alias("stub_name"),
        c("proposal_person").alias("pending_person"))
    rows = (inputs.filter("state IS NOT NULL AND state <> 'accepted'")
            .join(days, "ident", "left").join(waiting, "ident", "left"))
    attach = (F.when(c("state") == "attach_pending", c("record_person"))
              .when((c("state") == "pending") & (c("proposal_state") == "accepted"), c("new_person")))
    stub, target = c("pending_kind") == "new_stub", c("pending_kind") == "add_identifier"
    named, one = c("name").isNotNull(), c("name_candidates") == 1
    section = _case([
        ((c("state") == "dismissed") & c("hold_reason").eqNullSafe("wrong_match"),
         F.lit("note: wrong_match")),
        (c("state") == "dismissed", F.lit("note: dismissed")),
        (~valid_identifier(c("ident")), F.lit("not_a_number")),
        ((c("status") == "resolved") & c("is_owner").isNotNull(), F.lit("note: owner")),
        (c("status") == "resolved", F.lit("note: resolved")),
        (c("dismissed_id").isNotNull(), F.lit("note: dismissed")),
        (c("attach_person").isNotNull(), F.lit("attach")),
        (c("status") == "ambiguous", F.lit("ambiguous")),
        (stub & c("stub_name").isNotNull(), F.lit("new")),
        (stub, F.lit("bare")),
        (target & c("pending_person").isNotNull(), F.lit("known")),
        (target, F.lit("ambiguous")),
        ((c("proposal_kind") == "add_identifier") & one, F.lit("known")),
        (c("proposal_kind") == "add_identifier", F.lit("ambiguous")),
        ((c("proposal_kind") == "new_stub") & named, F.lit("new")),
        (c("proposal_kind") == "new_stub", F.lit("bare")),
        (F.lit(True), F.lit("not_a_number"))])
    reach = ((target & (c("pending_person") == c("attach_person")))
             | (c("attach_to") == c("attach_person")) | (c("record_attach") == c("attach_person")))
    goal = (F.when(c("section") == "attach", c("attach_person"))
            .when(c("section") == "known", F.coalesce(
                F.when(target, c("pending_person")), c("attach_to"))))
    return (rows.withColumn("attach_person", attach).withColumn("section", section)
            .select("ident", "section", "name", F.coalesce("days", F.lit(0)).alias("days"), "first",
                    "last", "state", goal.alias("target"),
                    _case([(c("section") == "attach", F.coalesce(reach, F.lit(False))),
                           (c("section").isin("known", "new"), F.lit(True)),
                           (F.lit(True), F.lit(False))]).alias("can_accept"),
                    (c("section") == "bare").alias("needs_name")))


def check_matches(inputs: DataFrame, identifiers: DataFrame, counts: DataFrame) -> DataFrame:
    """Accepted numbers whose only road to their card is a suffix, unconfirmed and not the
    owner's."""
    accepted = identifiers.filter(
        "state = 'accepted' AND NOT coalesce(match_route = 'exact', false)").select(
            "ident", "match_confirmed")
    return (inputs.join(accepted, "ident")
            .filter((F.col("status") == "resolved") & (F.col("route") == "suffix")
                    & F.col("is_owner").isNull()
                    & ~F.col("match_confirmed").eqNullSafe(F.col("person_id")))
            .join(counts, "ident", "left")
            .select("ident", "person_id", "matched_value", "matched_digits",
                    F.coalesce("filed", F.lit(0)).alias("filed"),
                    F.coalesce("waiting", F.lit(0)).alias("waiting")))


def review_rank(listing: DataFrame) -> DataFrame:
    """The listed rows numbered by section, days, last day, name, identifier."""
    section = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    rows = listing.filter(~F.col("section").startswith("note"))
    return number_rows(rows, [section.asc(), F.col("days").desc(), F.col("last").desc_nulls_last(),
                              F.lower("name").asc_nulls_last(), F.col("ident").asc()], "label")


def listing_fingerprint(ranked: DataFrame) -> DataFrame:
    """A code that changes when any shown field does.

    Order-free (the label is inside each row): sums of 32-bit pieces of a per-row digest, so it
    combines map-side.
    """
    shown = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
                                         for c in sorted(ranked.columns)]), 256)
    pieces = [F.conv(F.substring("row_code", 1 + 8 * i, 8), 16, 10).cast("bigint")
              for i in range(4)]
    return ranked.select(shown.alias("row_code")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(p).cast("string").alias(f"s{i}") for i, p in enumerate(pieces)]).select(
            "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"),
                                       *[f"s{i}" for i in range(4)]), 256).alias("token"))


def decisions_to_listing(decisions: DataFrame, ranked: DataFrame, cards: DataFrame) -> DataFrame:
    """Each decision with its row and the reason it must be refused (NULL when it may go on).

    A given name that is already a card's sends the row to that card, never to a second one.
    """
    per_label = decisions.groupBy("label").agg(F.count_distinct("action").alias("actions"))
    joined = decisions.withColumnRenamed("name", "decided_name").join(per_label, "label").join(
        ranked.select("label", "ident", "section", "target", "can_accept", "needs_name"),
        "label", "left")
    named = name_matches(decisions.filter("name IS NOT NULL").select(
        F.col("name").alias("ident"), "name").distinct(), cards).select(
        F.col("ident").alias("decided_name"), F.col("candidates").alias("cards_named"),
        F.col("lo").alias("named_card"))
    joined = look_up(joined, named, "decided_name", "label", "action")
    c, accept = F.col, F.col("action") == "accept"
    refusal = _case([
        (c("ident").isNull(), F.lit("no such row")),
        (c("actions") > 1, F.lit("accepted and dismissed")),
        (~accept & c("decided_name").isNotNull(), F.lit("the name is for a row not added")),
        (accept & c("decided_name").isNotNull() & ~c("section").isin("new", "bare"),
         F.lit("the row already has a card")),
        (accept & ~c("can_accept") & ~c("needs_name"), F.lit("cannot be accepted")),
        (accept & c("needs_name") & c("decided_name").isNull(), F.lit("needs a name")),
        (accept & (c("cards_named") > 1), F.lit("several cards have that name"))])
    attach = F.when(accept & (c("cards_named") == 1), c("named_card"))
    return (joined.withColumn("refusal", refusal)
            .withColumn("target", F.coalesce("target", attach))
            .select("label", "action", "decided_name", "ident", "section", "target", "refusal"))


def whole_batch(steps: DataFrame, ranked: DataFrame, token: str) -> DataFrame:
    """The steps of one batch, all of them refused if any is or if the list has changed.

    ``token`` is the fingerprint of the list that was shown.  The batch's own reason, that of
    its first refused row, is one value found by a top-1 and set beside every step.
    """
    batch = durable(steps)
    first = (batch.filter("refusal IS NOT NULL").orderBy("label", "action").limit(1)
             .agg(F.max("refusal"))).scalar()
    now = listing_fingerprint(ranked).agg(F.max("token")).scalar()
    return (batch.withColumn("_first", first).withColumn("_now", now)
            .withColumn("refusal", F.when(F.col("_now") != token, LIST_CHANGED)
                        .otherwise(F.coalesce("refusal", "_first")))
            .drop("_first", "_now"))


def dismiss_below(ranked: DataFrame, row: int) -> DataFrame:
    """A dismissal for every row under ``row``."""
    return ranked.filter(F.col("label") > row).select(
        "label", F.lit("dismiss").alias("action"), F.lit(None).cast("string").alias("name"))


def apply_accepts(steps: DataFrame, held: DataFrame, known: DataFrame, owners: DataFrame,
                  ) -> tuple[DataFrame, DataFrame]:
    """Accepted rows → identifier updates, and the held days they release to the queue.

    A row with a card to go to becomes ``accepted`` and lets its days go; a new person's number
    waits as ``attach_pending`` for the second yes.  ``known`` holds keys already stamped or queued.
    """
    yes = steps.filter("action = 'accept' AND refusal IS NULL")
    updates = yes.select(
        "ident", F.when(F.col("target").isNotNull(), "accepted").otherwise("attach_pending")
        .alias("new_state"), F.col("target").alias("person_id"))
    released = (held.select("ident", "key").join(
        updates.filter("new_state = 'accepted'").select("ident", "person_id"), "ident")
        .join(owners.select("person_id"), "person_id", "left_anti")
        .join(known.select("key"), "key", "left_anti"))
    return updates, released


def apply_dismissals(steps: DataFrame) -> DataFrame:
    """Dismissed rows → identifier updates; their held days simply stay unfiled."""
    return steps.filter("action = 'dismiss' AND refusal IS NULL").select(
        "ident", F.lit("dismissed").alias("new_state"), F.lit(None).cast("string").alias("hold_reason"))


def apply_wrong_matches(checks: DataFrame, queue: DataFrame, stamped: DataFrame) -> DataFrame:
    """Queued days of a wrong match, moved back to held; the person is pinned on them."""
    return (queue.select("ident", "key").join(checks.select(
        "ident", F.col("person_id").alias("match_person")), "ident")
        .join(stamped.select("key"), "key", "left_anti")
        .withColumn("reason", F.lit("wrong_match")))


def exclude_plan(wanted: DataFrame, own: tuple[str, ...] | DataFrame, listed: DataFrame,
                 identifiers: DataFrame, queue: DataFrame, held: DataFrame,
                 stamped: DataFrame) -> DataFrame:
    """Per identifier of an excluded person: what changes, what is dropped, what is set aside."""
    q = (queue.join(stamped.select("key"), "key", "left_anti").groupBy("ident")
         .agg(F.count(F.lit(1)).alias("queued_days")))
    h = held.groupBy("ident").agg(F.count(F.lit(1)).alias("held_days"))
    listed_flag = listed.select("ident").distinct().withColumn("_listed", F.lit(True))
    record = identifiers.select("ident", "state", "hold_reason")
    aside = F.col("state").isNotNull() & ~F.col("state").isin("accepted", "dismissed")
    return (wanted.select("ident").distinct()
            .join(listing(wanted.sparkSession, own), "ident", "left_anti")
            .join(listed_flag, "ident", "left").join(record, "ident", "left")
            .join(q, "ident", "left").join(h, "ident", "left")
            .select("ident", F.when(F.col("_listed"), "unchanged").otherwise("change").alias("plan"),
                    F.coalesce("queued_days", F.lit(0)).alias("queued_days"),
                    F.coalesce("held_days", F.lit(0)).alias("held_days"),
                    aside.alias("set_aside"),
                    F.when(aside, F.col("state")).alias("prior_state"),
                    F.when(aside, F.col("hold_reason")).alias("prior_reason")))


def cancelled_claims(excluded: DataFrame, queue: DataFrame, live: DataFrame) -> DataFrame:
    """Live claims that hold a queued day of an excluded identifier."""
    return (live.join(queue.select("key", "ident"), "key")
            .join(excluded.select("ident"), "ident", "left_semi").select("claim_id").distinct())


def include_plan(excluded: DataFrame) -> DataFrame:
    """The reverse: every number set aside returns to the state it had."""
    return excluded.filter("set_aside").select(
        "ident", F.coalesce("prior_state", F.lit("held")).alias("state"),
        F.col("prior_reason").alias("hold_reason"))
