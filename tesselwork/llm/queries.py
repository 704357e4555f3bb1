"""The queries over the subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fair_mixing, fm_classifier, html_blocks, line_edit_dedup, line_rules, quotation_linking, simhash_popcount, suffix_dedup, token_counts
from .sql import ORACLE_SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotation_linking.reply_order(_read(spark, sf_dir, "conversations"))
    return found.withColumns({"origin_conv": F.col("origin.conv_id"), "origin_turn": F.col("origin.turn")}).drop("origin")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n = F.size("items")
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", n.cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document measures the classifier; one without an id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op4_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = fm_classifier.train(docs, labels.where(~held_out(F.col("doc_id"))), metadata=("n_chars",))
    scored = fm_classifier.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = fair_mixing.fair_mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_popcount.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash_popcount.fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(_read(spark, sf_dir, "documents"))


def op9_line_edit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_edit_dedup.line_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.length("kept_text").cast("long").alias("n_kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_quotation_linking, op3_decontamination, op4_fm_quality, op5_fair_mixing, op6_simhash_popcount, op7_suffix_dedup, op8_line_rules, op9_line_edit_dedup, op10_html_blocks)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
