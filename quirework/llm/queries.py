"""The queries of this subpackage: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, extract, line_dedup, minhash, quality, substring, url_filter, warc
from .common import materialised, scratch_path
from .sql import ORACLE_SQL, op1

#: Where the public vocabulary file lies; a parameter of the operator, never copied.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/")]

ORACLE_SQL["op1_url_filter"] = op1(RULES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents")).withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.convert_arcs(warc.pages_to_arcs(table(spark, sf_dir, "pages")))
    named = records.withColumn("page_id", F.regexp_extract(F.decode("head", "UTF-8"), r"X-Page-Id: (-?\d+)", 1).try_cast("long"))
    groups = materialised(warc.repeated_payloads(named, "page_id"), "payloads")
    path = scratch_path(spark, "warc")
    warc.write_warcs(warc.with_revisits(named, "page_id", groups), F.col("page_id"), path)
    return warc.read_warcs(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.chat_digests(chat.format_chats(rows)).drop("error_turn")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_line_dedup, op3_warc, op4_minhash, op5_quality_rules, op6_html_extract, op7_bpe, op8_decontaminate, op9_substring_dedup, op10_chat_format)}
