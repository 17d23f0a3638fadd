"""Sources: document trees, glossaries, caches, label workspaces, raw files with a pluggable extractor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_id
from ..schemas import CACHE, DOCUMENT_JSON

SPANS = "document_id string, filename string, page int, width double, height double, native int, type int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, dir_y double, font_size double, font_name string, flags int, error string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document trees of schema versions 0.1 and 0.2, one JSON file each; a file that isn't one fails the read. What 0.1 lacks gets defaults."""
    raw = spark.read.schema(DOCUMENT_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    none = F.lit("")
    stats = F.coalesce("processing", F.struct(*[F.lit(0).alias(c) for c in ("provider_calls", "cache_hits", "resumed_blocks", "retained_blocks", "failed_blocks")]))
    return raw.withColumns({"processing": stats, "mode": F.coalesce("mode", F.lit("live")), "status": F.coalesce("status", F.lit("parsed")), "model": F.coalesce("model", none), "title": F.coalesce("title", none), "warnings": F.coalesce("warnings", F.array().cast("array<string>"))})


def blocks_of(documents: DataFrame) -> DataFrame:
    """A row for each block, with page and position (its place on the page)."""
    pages = documents.select("document_id", F.explode("pages").alias("p"))
    blocks = pages.select("document_id", F.col("p.page").alias("page"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.posexplode("p.blocks").alias("position", "b"))
    plain = ("block_id", "block_type", "section", "text", "confidence", "native_block_number", "protected_text", "raw_translation", "translation", "warnings", "check", "explanation")
    box = [F.get("b.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return blocks.select("document_id", "page", "width", "height", F.col("position").cast("long"), *box, *[F.col(f"b.{c}").alias(c) for c in plain], F.coalesce("b.protected_items", F.array()).alias("items"), F.coalesce("b.translation_status", F.lit("pending")).alias("translation_status"), F.coalesce("b.translation_origin", F.lit("none")).alias("translation_origin"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """source_term, preferred from a JSON object of strings; ValueError for anything else. A glossary is a small file that one person writes."""
    text = spark.read.text(path, wholetext=True).first()
    value = json.loads(text[0]) if text else {}
    if not isinstance(value, dict) or not all(isinstance(x, str) for x in value.values()):
        raise ValueError("a glossary is a JSON object of strings")
    return spark.createDataFrame(sorted(value.items()), "source_term string, preferred string")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, schema_version, raw_translation from one JSON file an entry, named by its key; files that aren't JSON read as null and so never hit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    entry = F.from_json(F.decode("content", "UTF-8"), "schema_version int, raw_translation string")
    rows = files.select(F.regexp_extract("path", r"([0-9a-f]+)\.json$", 1).alias("key"), entry.alias("e"))
    return rows.select("key", F.col("e.schema_version").alias("schema_version"), F.col("e.raw_translation").alias("raw_translation")).to(spark.createDataFrame([], CACHE).schema)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labels, manifests and other JSON tables with a fixed schema, an object a line or a file."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_files(spark: SparkSession, path: str, extract: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Spans of raw files. extract(content) yields a dict for each span with SPANS' columns but document_id and filename, and raises ValueError for a file it can't read, which becomes a row with error.

    No extractor comes along: pass one on top of whatever PDF library the cluster has.
    """
    files = spark.read.format("binaryFile").load(path).select(content_id(F.col("content")).alias("document_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")
    columns = [c.split(" ")[0] for c in SPANS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, name, content in zip(batch["document_id"], batch["filename"], batch["content"], strict=True):
                try:
                    if not content:
                        raise ValueError("the file is empty")
                    rows = list(extract(bytes(content)))
                    if not rows:
                        raise ValueError("the file has no pages")
                except ValueError as e:
                    rows = [{"error": str(e)}]
                yield pd.DataFrame([{**dict.fromkeys(columns), **r, "document_id": doc, "filename": name} for r in rows], columns=columns)

    return files.mapInPandas(run, SPANS)
