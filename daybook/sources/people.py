"""People-side sources: contact stores, cards, dated card lines, profiles, proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.text import (clean_label, display_name, normalise_handle, strip)

# --- fixed values: line shapes and labels ------------------------------------------------
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
CARD_LINE = (r"(?U)^-\s+(\d{4}-\d{2}-\d{2})\s+[—–-]\s+conversation\s*"
             r"\((\w+)\)\s*:?\s*(.*)$")
CARD_LINK = r"(?U)\(\s*→\s*([^)]+)\)"
PROFILE_LABELS = ("**Email:**", "**Google:**")
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PAYLOAD = "kind STRING, identifier STRING, name STRING, person STRING"
# --- end of fixed values -----------------------------------------------------------------


def scan_contacts(stores: DataFrame) -> DataFrame:
    """canonical identifier → name over every store; the first store, then row, wins.

    ``stores`` carries store_rank, kind_rank (0 phone, 1 address), row_no, the name parts and
    the raw value.  A MIN over the ranking struct combines map-side, so a number that every
    store repeats does not pile up in one task.
    """
    name = display_name(F.col("first_name"), F.col("last_name"), F.col("org"))
    rows = (stores.filter(F.col("raw").contains("@") == (F.col("kind_rank") == 1))
            .select(normalise_handle(F.col("raw")).alias("ident"), name.alias("name"),
                    "store_rank", "kind_rank", "row_no")
            .filter("ident IS NOT NULL AND name IS NOT NULL"))
    return (rows.groupBy("ident")
            .agg(F.min(F.struct("store_rank", "kind_rank", "row_no", "name")).alias("best"))
            .select("ident", "best.name"))


def card_identifiers(cards: DataFrame) -> DataFrame:
    """(person_id, name, ident, kind): every number and address on a card, once per card.

    Normalised before the explode, so later filters meet a plain column and are not rewritten
    into copies of the whole normalisation.
    """
    return (cards.select("person_id", "name", F.explode(F.transform(
                F.array("phone", "shared_phone", "email"), normalise_handle)).alias("ident"))
            .filter("ident IS NOT NULL")
            .withColumn("kind", F.when(F.col("ident").contains("@"), "email").otherwise("phone"))
            .dropDuplicates(["person_id", "ident"]))


def dated_lines(documents: DataFrame) -> DataFrame:
    """Text cards → one row per dated conversation line of the Interactions section.

    Sections are split off first, so no state is carried from line to line.
    """
    sections = documents.select("doc_id", F.posexplode(
        F.split(F.concat(F.lit("\n"), "text"), rf"(?:{LINE_BREAK})## ")).alias("no", "body"))
    lines = (sections.filter("no > 0").select("doc_id", "no", F.posexplode(
        F.split("body", LINE_BREAK)).alias("pos", "raw"), F.lower(strip(F.element_at(
            F.split("body", LINE_BREAK), 1))).alias("title"))
        .filter("title = 'interactions' AND pos > 0"))
    line = strip(F.col("raw"))
    rest = F.regexp_extract(line, CARD_LINE, 3)
    link = strip(F.regexp_extract(rest, CARD_LINK, 1))
    summary = strip(F.regexp_replace(rest, CARD_LINK, ""))
    return lines.filter(line.rlike(CARD_LINE)).select(
        "doc_id", (F.col("no") * 1_000_000 + F.col("pos")).alias("at"),
        F.regexp_extract(line, CARD_LINE, 1).alias("day"),
        F.regexp_extract(line, CARD_LINE, 2).alias("direction"),
        F.when(summary != "", summary).alias("summary"), F.when(link != "", link).alias("link"))


def labelled_addresses(documents: DataFrame) -> DataFrame:
    """Addresses on lines that carry a profile label; the first line naming one keeps it."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", LINE_BREAK)).alias("no", "line"))
    label = F.coalesce(*[F.when(F.col("line").contains(x), F.lit(x.strip("*:")))
                         for x in PROFILE_LABELS])
    found = (lines.withColumn("label", label).filter("label IS NOT NULL")
             .select("doc_id", "no", "label",
                     F.posexplode(F.regexp_extract_all("line", F.lit(ADDRESS), 0))
                     .alias("pos", "address")))
    return (found.groupBy("doc_id", F.lower("address").alias("address_key"))
            .agg(F.min(F.struct("no", "pos", "address", "label")).alias("first"))
            .select("doc_id", "first.address", "first.label"))


def parsed_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals with their payload read; rows whose payload cannot be read drop out.

    Read before the explode, so later filters do not read the payload again for each field.
    """
    return (proposals.filter(F.col("kind").isin("new_stub", "add_identifier"))
            .select("proposal_id", "kind", "status", "created", F.explode(F.array(
                F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"}))).alias("p"))
            .filter("p.identifier IS NOT NULL")
            .select("proposal_id", "kind", "status", "created",
                    F.col("p.identifier").alias("ident"),
                    clean_label(F.col("p.name")).alias("proposal_name"),
                    F.col("p.person").alias("proposal_person"))
            .filter((F.col("ident").contains("@")) | F.col("ident").startswith("+")))


def newest_proposals(proposals: DataFrame) -> DataFrame:
    """Newest proposal per identifier and status (a map-side-combining MAX, no window)."""
    return (parsed_proposals(proposals).groupBy("ident", "status")
            .agg(F.max(F.struct("proposal_id", "kind", "proposal_name", "proposal_person"))
                 .alias("newest"))
            .select("ident", "status", "newest.*"))
