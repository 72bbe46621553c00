"""The queries of this subpackage over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.llm import chat, exact, html, lmscore, mixing, packing, pii, quality, simhash, substrings
from catalens.llm import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op2_chat_format": sql.CHAT,
    "op6_exact_dedup": sql.EXACT,
    "op7_quality_rules": sql.QUALITY,
    "op9_substring_dedup": sql.SUBSTRINGS,
    "op10_source_mixing": sql.MIXING,
}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    base = ~quality.passes(quality.BASE)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & quality.passes(quality.STANDARD)).alias("kept"), "failed_bits",
    )


@_query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@_query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(added)))


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@_query
def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", pii.is_base(k))).cast("bigint").alias(f"n_{k}") for k in pii.BASE_KINDS]
    base = F.sha2(pii.joined(F.filter("spans", lambda s: s["base"])), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@_query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))
