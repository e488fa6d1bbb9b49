"""The numbered corpus queries: thin steps between the given tables and the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.close_vectors import close_vectors
from daybook.llm.contamination import contained_items
from daybook.llm.language import fit_message_language, identify_languages
from daybook.llm.middles import fill_in_middle, restore_messages
from daybook.llm.near_copies import near_copies
from daybook.llm.packing import pack_messages
from daybook.llm.repeated_passages import remove_repeated_passages
from daybook.llm.repetition import repetition_verdicts
from daybook.llm.rule_ensemble import fit_rule_ensemble, rate_messages
from daybook.llm.secret_scan import fit_secret_network, labelled_findings, scan_secrets
from daybook.llm.spelling import message_words, spelling_variants
from daybook.llm.suffix_tree import score_messages
from daybook.llm.texts import crc_fold
from daybook.llm.token_counts import count_message_tokens
from daybook.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, base: str) -> DataFrame:
        return fn(configure(spark), base)
    QUERIES[fn.__name__] = run
    return fn


def documents(spark: SparkSession, base: str, *more: str | Column) -> DataFrame:
    """The documents as message rows: ``rowid, text`` and the named columns."""
    rows = spark.read.parquet(f"{base}/documents.parquet")
    return rows.select(F.col("doc_id").alias("rowid"), "text", *more)


@query
def op6_token_counts(spark: SparkSession, base: str) -> DataFrame:
    counted = count_message_tokens(documents(spark, base), public_tokenizers.path(VOCABULARY))
    return counted.withColumnRenamed("rowid", "doc_id")


@query
def op9_repetition_rules(spark: SparkSession, base: str) -> DataFrame:
    return repetition_verdicts(documents(spark, base)).withColumnRenamed("rowid", "doc_id")


@query
def op3_near_copies(spark: SparkSession, base: str) -> DataFrame:
    return near_copies(documents(spark, base)).withColumnRenamed("rowid", "doc_id")


@query
def op5_contained_items(spark: SparkSession, base: str) -> DataFrame:
    items = spark.read.parquet(f"{base}/benchmark.parquet")
    return contained_items(documents(spark, base), items).withColumnRenamed("rowid", "doc_id")


@query
def op7_vector_packing(spark: SparkSession, base: str) -> DataFrame:
    packed = pack_messages(documents(spark, base), public_tokenizers.path(VOCABULARY))
    return packed.withColumnRenamed("rowid", "doc_id")


@query
def op1_rule_ensemble(spark: SparkSession, base: str) -> DataFrame:
    messages = documents(spark, base)
    verdicts = (spark.read.parquet(f"{base}/labels.parquet").filter(crc_fold("doc_id", 3) != 1)
                .select(F.col("doc_id").alias("rowid"), F.col("quality").alias("keep")))
    rated = rate_messages(messages, fit_rule_ensemble(messages, verdicts))
    return rated.select(F.col("rowid").alias("doc_id"), (crc_fold("rowid", 3) == 1)
                        .alias("held_out"), "score", "predicted")


@query
def op2_language(spark: SparkSession, base: str) -> DataFrame:
    messages = documents(spark, base, F.col("lang").alias("language"))
    model = fit_message_language(messages.filter(crc_fold("rowid", 3) != 1))
    told = identify_languages(messages, model)
    return told.select(F.col("rowid").alias("doc_id"), (crc_fold("rowid", 3) == 1)
                       .alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_secret_scan(spark: SparkSession, base: str) -> DataFrame:
    messages = documents(spark, base)
    net = fit_secret_network(labelled_findings(messages))
    return scan_secrets(messages, net).withColumnRenamed("rowid", "doc_id")


@query
def op4_suffix_tree(spark: SparkSession, base: str) -> DataFrame:
    messages = documents(spark, base).withColumn("learned", crc_fold("rowid", 10) != 0)
    scored = score_messages(messages)
    return scored.select(F.col("rowid").alias("doc_id"), (~F.col("learned")).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_repeated_passages(spark: SparkSession, base: str) -> DataFrame:
    return remove_repeated_passages(documents(spark, base)).withColumnRenamed("rowid", "doc_id")


@query
def op11_fill_in_middle(spark: SparkSession, base: str) -> DataFrame:
    samples = restore_messages(fill_in_middle(documents(spark, base)))
    return samples.select(F.col("rowid").alias("doc_id"), "n", "form", "prefix_chars",
                          "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                          F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS d,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents),
cut AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         ('0x' || substr(d, 1, 8))::BIGINT % (len(units) + 1) AS c1,
         ('0x' || substr(d, 9, 8))::BIGINT % (len(units) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR ('0x' || substr(d, 17, 8))::BIGINT % 100 >= 100
              THEN 'plain'
              WHEN ('0x' || substr(d, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
pieces AS (
  SELECT doc_id, text, n, form,
         coalesce(array_to_string(units[1:least(c1, c2)], ''), '') AS p,
         coalesce(array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m,
         coalesce(array_to_string(units[greatest(c1, c2) + 1:n], ''), '') AS s
  FROM cut),
samples AS (
  SELECT doc_id, n, form, length(p) AS prefix_chars, length(m) AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output
  FROM pieces)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN prefix_chars END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN middle_chars END AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
         WHEN 'psm' THEN split_part(substr(output, 4), '<S>', 1) || split_part(output, '<M>', 2)
                         || split_part(split_part(output, '<S>', 2), '<M>', 1)
         ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2)
              || split_part(substr(output, 4), '<P>', 1) END) AS restored_sha256
FROM samples
"""


@query
def op12_close_vectors(spark: SparkSession, base: str) -> DataFrame:
    return close_vectors(spark.read.parquet(f"{base}/embeddings.parquet"))


@query
def op13_spelling_variants(spark: SparkSession, base: str) -> DataFrame:
    words = message_words(documents(spark, base))
    drawn = F.crc32(F.concat(F.coalesce(F.col("rowid").cast("string"), F.lit("")), F.lit(":"),
                             "word").cast("binary"))
    slip = "concat(left(word, cast(h % length(word) AS int)), " \
           "substring(word, cast(h % length(word) AS int) + 2))"
    slipped = words.withColumn("h", drawn).select(
        F.expr(f"if(h % 199 = 0, {slip}, word)").alias("word"))
    return spelling_variants(slipped)


@query
def pipeline(spark: SparkSession, base: str) -> DataFrame:
    import corpus_pipeline  # it stands at the top of the repository and imports this package

    return corpus_pipeline.run(spark, base)
