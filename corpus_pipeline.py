"""A training corpus from raw documents: five stages, each an operator of quirework.llm on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import bpe, decontaminate, line_dedup, minhash, quality
from quirework.llm.common import free_name, materialised, tidied
from quirework.llm.queries import VOCABULARY


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row's own, as ids can be null or shared, and the name of that column. Written, so that the numbers hold."""
    name = free_name(docs, "row")
    return materialised(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def without_rows(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """rows (numbered) without those whose number is in gone (one column), and without the column."""
    out = materialised(gone.toDF(name), "gone")
    # What goes grows with the corpus: sorted and merged at every size, never broadcast.
    return rows.join(out.hint("merge"), name, "left_anti").drop(name)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, then documents that fail the base rules or lose too much."""
    return quality.clean_documents(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go, and documents without a line left."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the least id stays, of rows with that id one; a null id is the greatest."""
    rows, name = numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(name).alias("row"))
    found = minhash.near_duplicates(rows.select(key.alias("doc_id"), "text"), k=5, percent=80)
    return without_rows(rows, name, found.filter(~F.col("kept")).select("doc_id.row"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, name = numbered(docs)
    found = decontaminate.contamination(rows.select(F.col(name).alias("doc_id"), "text"), benchmark)
    return without_rows(rows, name, found.filter("contaminated").select("doc_id"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return bpe.digests(docs, VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't express the last stage.
ORACLE_SQL: str | None = None


@tidied
def written(stage: Callable[[SparkSession, DataFrame, str], DataFrame], name: str, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return materialised(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage, name, spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)
