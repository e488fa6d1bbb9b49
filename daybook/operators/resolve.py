"""Identifier → person: exact, then by trailing digits, then by name; and names → people."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.functions.text import key_ident, only_digits, word_list, word_text
from daybook.operators.shape import look_up
from daybook.session import durable

SUFFIX_MIN = 7


def _nfkc_casefold(column: Column) -> Column:
    """Compatibility folding in Python; nested, so workers need no copy of this package."""
    def fold(names: pd.Series) -> pd.Series:
        return names.map(
            lambda n: None if n is None else unicodedata.normalize("NFKC", n).casefold())

    return F.pandas_udf(fold, T.StringType())(column)


def folded_names(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``column`` compatibility-folded into ``out``.

    ASCII names stay in the JVM; only the others cross into Python, as Arrow batches.
    """
    ascii_only = F.coalesce(F.col(column).rlike(r"^\p{ASCII}*$"), F.lit(True))
    return (df.filter(ascii_only).withColumn(out, F.lower(column)).unionByName(
        df.filter(~ascii_only).withColumn(out, _nfkc_casefold(F.col(column)))))


def _people_per(df: DataFrame, *keys: str) -> DataFrame:
    """Per key: lowest and highest person.  Equal means exactly one; no list is gathered."""
    return df.groupBy(*keys).agg(F.min("person_id").alias("lo"), F.max("person_id").alias("hi"))


def exact_matches(idents: DataFrame, card_ids: DataFrame) -> DataFrame:
    """Identifiers that are written on a card."""
    return idents.select("ident").join(_people_per(card_ids, "ident"), "ident")


def _endings(digits: Column, longest: Column) -> Column:
    return F.transform(F.sequence(F.lit(SUFFIX_MIN), longest), lambda n: F.right(digits, n))


def suffix_pairs(idents: DataFrame, card_ids: DataFrame) -> DataFrame:
    """Phones whose digits end in a card's digits, or the other way round; seven at least.

    Each side is expanded to its own endings (nine at most) and joined on equality, so only
    true matches are produced: no block of look-alikes is ever compared pairwise.
    """
    def phones(df: DataFrame) -> DataFrame:
        return (df.filter(~F.col("ident").contains("@"))
                .withColumn("digits", only_digits(F.col("ident")))
                .filter(F.length("digits") >= SUFFIX_MIN))

    asked = phones(idents.select("ident"))
    known = (phones(card_ids.select("ident", "person_id"))
             .groupBy("digits").agg(F.min("person_id").alias("lo"), F.max("person_id").alias("hi"),
                                    F.min("ident").alias("card_value")))
    short_card = (asked.withColumn("ending", F.explode(_endings(F.col("digits"), F.length("digits"))))
                  .join(known.withColumnRenamed("digits", "ending"), "ending")
                  .select("ident", "lo", "hi", "card_value", F.length("ending").alias("shared")))
    long_card = (known.filter(F.length("digits") > SUFFIX_MIN)
                 .withColumn("ending", F.explode(_endings(F.col("digits"), F.length("digits") - 1)))
                 .groupBy("ending").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                        F.min("card_value").alias("card_value"))
                 .join(asked.withColumnRenamed("digits", "ending"), "ending")
                 .select("ident", "lo", "hi", "card_value", F.length("ending").alias("shared")))
    return short_card.unionByName(long_card)


def suffix_matches(idents: DataFrame, card_ids: DataFrame) -> DataFrame:
    """Suffix matches per identifier, for those with no exact match only."""
    open_ids = idents.select("ident").join(card_ids.select("ident"), "ident", "left_anti")
    return suffix_pairs(open_ids, card_ids).groupBy("ident").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max(F.struct("shared", "card_value")).alias("best")).select(
            "ident", "lo", "hi", F.col("best.shared").alias("shared"),
            F.col("best.card_value").alias("card_value"))


def name_matches(idents: DataFrame, cards: DataFrame) -> DataFrame:
    """Identifiers whose name equals a card's name once both are folded to words."""
    known = (folded_names(cards.select("person_id", "name"), "name", "folded")
             .withColumn("name_key", word_text(F.col("folded"))).filter("name_key <> ''")
             .groupBy("name_key").agg(F.min("person_id").alias("lo"), F.max("person_id").alias("hi"),
                                      F.count_distinct("person_id").alias("candidates")))
    asked = (folded_names(idents.filter("name IS NOT NULL").select("ident", "name"), "name",
                          "folded").withColumn("name_key", word_text(F.col("folded"))))
    return asked.join(known, "name_key").select("ident", "lo", "hi", "candidates")


def resolve_identifiers(idents: DataFrame, card_ids: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per identifier: resolved, ambiguous, proposed (which kind) or unresolved.

    Dry: nothing is written.  ``idents`` must hold each identifier once (the caller reduces
    days to identifiers first, so the joins run per identifier and not per day).  They feed four
    joins, so they are checkpointed: whatever made them runs once.
    """
    idents = durable(idents)
    exact = exact_matches(idents, card_ids).select(
        "ident", F.col("lo").alias("e_lo"), F.col("hi").alias("e_hi"))
    tail = suffix_matches(idents, card_ids).select(
        "ident", F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"), "shared", "card_value")
    named = name_matches(idents, cards).select(
        "ident", F.col("lo").alias("n_lo"), "candidates")
    joined = (idents.join(exact, "ident", "left").join(tail, "ident", "left")
              .join(named, "ident", "left"))
    lo, hi = F.coalesce("e_lo", "s_lo"), F.coalesce("e_hi", "s_hi")
    status = (F.when(F.col("ident").isNull(), "unresolved").when(lo.isNull(), "proposed")
              .when(lo == hi, "resolved").otherwise("ambiguous"))
    return joined.select(
        *idents.columns, status.alias("status"),
        F.when(lo == hi, lo).alias("person_id"),
        F.when(F.col("e_lo").isNotNull(), "exact").when(F.col("s_lo").isNotNull(), "suffix")
        .alias("route"),
        F.when(F.col("e_lo").isNull(), F.col("shared")).alias("matched_digits"),
        F.when(F.col("e_lo").isNull(), F.col("card_value")).alias("matched_value"),
        F.when(F.col("ident").isNotNull() & lo.isNull(),
               F.when(F.col("candidates") > 0, "add_identifier").otherwise("new_stub"))
        .alias("proposal_kind"),
        F.when(lo.isNull(), F.coalesce("candidates", F.lit(0))).otherwise(F.lit(0))
        .cast("bigint").alias("name_candidates"),
        F.when(lo.isNull() & (F.col("candidates") == 1), F.col("n_lo")).alias("attach_to"))


def ambiguous_candidates(resolved: DataFrame, card_ids: DataFrame) -> DataFrame:
    """(ident, person_id) rows of everyone an ambiguous number may be, as rows, not lists."""
    asked = resolved.filter("status = 'ambiguous'").select("ident", "route")
    exact = (asked.filter("route = 'exact'").join(card_ids, "ident").select("ident", "person_id"))
    by_tail = asked.filter("route = 'suffix'")
    known = (card_ids.filter("kind = 'phone'")
             .withColumn("digits", only_digits(F.col("ident"))).select("digits", "person_id"))
    digits = by_tail.withColumn("digits", only_digits(F.col("ident")))
    shorter = (digits.withColumn("ending", F.explode(_endings(F.col("digits"), F.length("digits"))))
               .join(known.withColumnRenamed("digits", "ending"), "ending"))
    longer = (known.filter(F.length("digits") > SUFFIX_MIN)
              .withColumn("ending", F.explode(_endings(F.col("digits"), F.length("digits") - 1)))
              .join(digits.withColumnRenamed("digits", "ending"), "ending"))
    return exact.unionByName(shorter.select("ident", "person_id")).unionByName(
        longer.select("ident", "person_id")).distinct()


def owner_persons(own: DataFrame, card_ids: DataFrame, cards: DataFrame) -> DataFrame:
    """The persons the owner's own handles resolve to, each to exactly one card."""
    asked = own.select("ident").distinct().withColumn("name", F.lit(None).cast("string"))
    return (resolve_identifiers(asked, card_ids, cards).filter("status = 'resolved'")
            .select("person_id").distinct())


# --- names → people ---------------------------------------------------------------------


def _tokens(df: DataFrame, key: str, column: str) -> DataFrame:
    return (folded_names(df.select(key, column), column, "folded")
            .withColumn("words", word_list(F.col("folded")))
            .filter(F.size("words") > 0).select(key, column, "words"))


def match_people(queries: DataFrame, people: DataFrame) -> DataFrame:
    """Best-tier matches of each query's words: 3 same words, 2 all present, 1 all prefixes.

    Every tier needs each query word to open some word of the name, so candidates come from
    the query's rarest word alone: a word that names half the directory is never the join key
    while a rarer one exists.
    """
    asked = durable(_tokens(queries, "query_id", "query"))
    known = durable(_tokens(people, "person_id", "name"))
    # Only two letters or more open a longer word, so a lone letter never stands for a prefix.
    opening = known.select("person_id", F.explode(F.array_distinct(F.flatten(F.transform(
        "words", lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(F.transform(
            F.sequence(F.lit(2), F.greatest(F.length(w), F.lit(2))),
            lambda n: F.substring(w, F.lit(1), n))))))
        ).alias("opening"))
    frequency = opening.groupBy("opening").agg(F.count(F.lit(1)).alias("people"))
    rarest = (asked.select("query_id", F.explode(F.array_distinct("words")).alias("opening"))
              .join(frequency, "opening", "left")
              .groupBy("query_id").agg(F.min(F.struct(
                  F.coalesce("people", F.lit(0)).alias("people"), "opening")).alias("r"))
              .filter("r.people > 0").select("query_id", F.col("r.opening").alias("opening")))
    pairs = (rarest.join(opening, "opening").select("query_id", "person_id")
             .join(asked.select("query_id", F.col("words").alias("q")), "query_id")
             .join(known.select("person_id", "name", F.col("words").alias("n")), "person_id"))
    tier = (F.when(F.sort_array("q") == F.sort_array("n"), 3)
            .when(F.forall("q", lambda w: F.array_contains("n", w)), 2)
            .when(F.forall("q", lambda w: (F.length(w) >= 2)
                           & F.exists("n", lambda h: h.startswith(w))), 1).otherwise(0))
    scored = pairs.withColumn("tier", tier).filter("tier > 0")
    return (scored.withColumn("top", F.max("tier").over(W.partitionBy("query_id")))
            .filter(F.col("tier") == F.col("top"))
            .withColumn("matches", F.count(F.lit(1)).over(W.partitionBy("query_id")))
            .select("query_id", "person_id", "name", "tier",
                    F.when(F.col("matches") > 1, "ambiguous").otherwise("one").alias("status")))


def fold_contact_twins(contacts: DataFrame, cards: DataFrame) -> DataFrame:
    """Contacts folded into the card that has exactly the same words, in any order."""
    def keyed(df: DataFrame, key: str) -> DataFrame:
        return _tokens(df, key, "name").withColumn(
            "twin_key", F.array_join(F.sort_array("words"), " "))

    card = keyed(cards, "person_id").groupBy("twin_key").agg(F.min("person_id").alias("person_id"))
    return keyed(contacts, "ident").join(card, "twin_key", "left").select(
        "ident", "name", "person_id")


# --- ties the ledger already holds ---------------------------------------------------------


def ledger_people(identifiers: DataFrame, queue: DataFrame, stamped: DataFrame) -> DataFrame:
    """(person_id, ident) over identifiers, queue and stamped days, each pair once."""
    ties = (identifiers.select("person_id", "ident")
            .unionByName(queue.select("person_id", "ident"))
            .unionByName(stamped.select("person_id", key_ident(F.col("key")).alias("ident"))))
    return ties.filter("person_id IS NOT NULL AND ident IS NOT NULL").distinct()


def identifier_to_person(asked: DataFrame, identifiers: DataFrame, ties: DataFrame,
                         resolved: DataFrame) -> DataFrame:
    """Number → person: an accepted record, else any ledger tie, else the dry resolution."""
    options = (identifiers.filter("state = 'accepted' AND person_id IS NOT NULL")
               .select("ident", F.lit(1).alias("priority"), "person_id")
               .unionByName(ties.select("ident", F.lit(2).alias("priority"), "person_id"))
               .unionByName(resolved.filter("status = 'resolved'")
                            .select("ident", F.lit(3).alias("priority"), "person_id")))
    best = options.groupBy("ident").agg(F.min(F.struct("priority", "person_id")).alias("b"))
    return asked.select("ident").join(best, "ident", "left").select(
        "ident", "b.person_id", "b.priority")


def enrich_names(records: DataFrame, cards: DataFrame, contacts: DataFrame,
                 masked: Column) -> DataFrame:
    """Display name: the card's, else the contact's, else the stored one, else a masked handle."""
    named = look_up(records, cards.select("person_id", F.col("name").alias("card_name")),
                    "person_id", "ident")
    return (named.join(contacts.select("ident", F.col("name").alias("contact_name")), "ident", "left")
            .withColumn("shown_name", F.coalesce("card_name", "contact_name", "stored_name", masked))
            .drop("card_name", "contact_name"))


