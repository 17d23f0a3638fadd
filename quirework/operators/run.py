"""Whole runs: spans to classified blocks, and blocks to translated documents, over any number of documents at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import delete, read_packed, settings, stored_bytes, write_packed
from ..sources.sinks import write_cache
from . import context, translate
from .classify import classify
from .layout import page_warnings, reading_order
from .segment import OCR_PAGE, build_blocks, document_summary, group_lines, ocr_flags, spans_to_lines

DEMO_NOTICE = "A demonstration: blocks repeat their source; nothing was translated or checked."


class Parsed(NamedTuple):
    blocks: DataFrame
    pages: DataFrame
    documents: DataFrame


def parse_spans(spans: DataFrame) -> Parsed:
    """Blocks with types, sections and places, pages with layout and warnings, documents with title and warnings. spans: as read_files gives them, files without an error."""
    blocks = build_blocks(group_lines(spans_to_lines(spans)))
    typed = classify(reading_order(blocks))
    flags = ocr_flags(blocks).select("document_id", "page", "requires_ocr")
    sizes = spans.groupBy("document_id", "page").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    layouts = page_warnings(typed)
    pages = sizes.join(flags, ["document_id", "page"], "left").join(layouts, ["document_id", "page"], "left")
    bare = F.coalesce("requires_ocr", F.lit(True))
    notes = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.when(bare, F.array(F.lit(OCR_PAGE))).otherwise(F.array().cast("array<string>")))
    pages = pages.withColumns({"layout": F.coalesce("layout", F.lit("single_column")), "warnings": notes, "requires_ocr": bare})
    stems = spans.groupBy("document_id").agg(F.first("filename").alias("filename")).withColumn("stem", F.regexp_replace("filename", r"\.[^.]*$", ""))
    documents = document_summary(typed, pages, stems.select("document_id", "stem")).join(stems.select("document_id", "filename"), "document_id")
    return Parsed(typed, pages, documents)


@dataclass(frozen=True)
class Options:
    """identity: of the provider, for cache keys; without one nothing is cached. terminology: terms and their translations. retry: none, or which blocks of a previous run are translated anew (failed, risky or all)."""

    target_language: str = "Simplified Chinese"
    model: str = ""
    identity: str = ""
    retry: str = "none"
    demo: bool = False
    most_chars: int = 16000
    context_chars: int = 6000
    terminology: Mapping[str, str] = field(default_factory=dict)


class Translated(NamedTuple):
    blocks: DataFrame
    documents: DataFrame


def requests(blocks: DataFrame, o: Options, old: DataFrame | None = None) -> DataFrame:
    """blocks with protected_text and items, key (of the cache, from the whole context) and user (the request's JSON, from the bounded one); with old, as beside_old takes it, also _old."""
    terms = F.create_map(*[F.lit(x) for pair in sorted(o.terminology.items()) for x in pair]) if o.terminology else F.create_map().cast("map<string,string>")
    rows = context.with_context(blocks, context.sorted_json(terms))
    # Before the texts go through Python, behind which Spark doesn't know any more that a document's rows are together.
    rows = translate.protected(rows if old is None else translate.beside_old(rows, old))
    key = context.cache_key(F.lit(o.identity), F.lit(o.target_language), F.col("protected_text"), F.col("section"), F.col("previous"), F.col("next"), F.col("abstract"), F.col("terminology"))
    full = rows.withColumns({"key": key, "_section": F.col("section")})
    cut = context.bounded(full, o.context_chars)
    user = F.to_json(F.struct(F.lit(o.target_language).alias("target_language"), F.struct("section", "terminology", "previous", "next").alias("context"), F.col("protected_text").alias("current_text")))
    return cut.withColumn("user", user).withColumn("section", F.col("_section")).drop("_section", "previous", "next", "abstract", "terminology")


def check_previous(blocks: DataFrame, previous: DataFrame | None, o: Options) -> None:
    """Raises ValueError unless the run may build on the previous documents (document_id, target_language, model, mode)."""
    new = {"document_id": None, "target_language": o.target_language, "model": o.model}
    translate.validate_previous(new, None if previous is None else new | {"mode": "live"}, o.retry, o.demo)
    if previous is None:
        return
    known = previous.join(blocks.select("document_id").distinct(), "document_id", "left_semi")
    for old in previous.select("target_language", "model", "mode").distinct().limit(100).collect():
        translate.validate_previous(new, {"document_id": None, **old.asDict()}, o.retry)
    if previous.count() > known.count():
        raise ValueError("the previous run has another document_id")


#: Shuffle files go with the query that wrote them, tables dealt by document are joined by document and block as they lie, and Python gets few long texts at once.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
#: Blocks that meet a previous run or a cache are finished in so many parts of the documents, one after the other, unless all of them together are small.
PARTS, SMALL = 4, 32 << 20
#: Texts of a block that repeat each other.
TEXTS = ("text", "protected_text", "user", "raw", "translation")


def translate_blocks(blocks: DataFrame, pages: DataFrame, documents: DataFrame, o: Options, make_client: Callable[[], Callable[[str, str], str]] | None, work: str, cache: str | None = None, previous: Translated | None = None) -> Translated:
    """A run over blocks (document_id, page, position, block_id, block_type, section, text, warnings), pages (document_id, page, requires_ocr, layout) and documents (document_id, warnings).

    A block's translation comes from the first of: itself (retained types), the previous run, the cache, the provider.
    What the provider says is written under work before it is checked, so nothing that runs later repeats a call; what
    passed without a warning is appended to the cache. Both results are read back from work, where nothing else is left.
    """
    spark = blocks.sparkSession
    with settings(spark, SETTINGS):
        check_previous(blocks, previous.documents if previous else None, o)
        done = _translated(blocks, o, make_client, work, cache, previous)
        if not o.demo and cache and o.identity and o.retry != "all":
            write_cache(translate.admitted(done), cache)

        results = done.select("document_id", "origin", F.col("translation_status").alias("status"), "called", F.col("check.passed").alias("passed"))
        status = translate.document_status(documents, results, pages, o.demo)
        notes = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array(*([F.lit(DEMO_NOTICE)] if o.demo else [])).cast("array<string>"))
        stated = documents.withColumn("warnings", notes).join(status, "document_id").join(translate.processing_stats(results), "document_id", "left").na.fill(0, ["provider_calls", "cache_hits", "resumed_blocks", "retained_blocks", "failed_blocks"])
        stated.withColumns({"target_language": F.lit(o.target_language), "model": F.lit(o.model), "mode": F.lit("demo" if o.demo else "live")}).write.parquet(f"{work}/documents")
    return Translated(done, spark.read.parquet(f"{work}/documents"))


def part_of(document_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(document_id).cast("string")), F.lit(PARTS)).cast("int")


def _translated(blocks: DataFrame, o: Options, make_client, work: str, cache: str | None, previous: Translated | None) -> DataFrame:
    """Blocks with their translations, written under work."""
    spark = blocks.sparkSession
    # One shuffle of the blocks as they came: context, keys and calls all go by document.
    made = lambda rows, old=None: requests(rows.repartition("document_id").withColumn("seq", F.struct("page", "position")), o, old)
    cached = bool(not o.demo and cache and o.identity and o.retry != "all") and stored_bytes(spark, cache) > 0
    if not cached and not previous:
        schema = _finish(made(blocks), o, make_client, work)
        return read_packed(spark, [f"{work}/blocks"], TEXTS, schema)
    # The cache is asked for all keys first, so requests wait; else blocks do, and requests, with their several texts a block, are made of one part after the other.
    kept = write_packed((made(blocks) if cached else blocks).withColumn("_part", part_of("document_id")), f"{work}/waiting", TEXTS, "_part")
    places = [f"{work}/waiting/_part={i}" for i in range(PARTS)]
    stored = lambda i: read_packed(spark, [x for x in (places if i is None else [places[i]]) if stored_bytes(spark, x)], TEXTS, kept)
    if previous:
        names = {"raw": "raw_translation"}
        old = translate.as_old(previous.blocks.select("document_id", "block_id", *[F.col(c).alias(names.get(c, c)) for c in ("text", "items", "protected_text", "raw", "translation", "translation_status", "check", "explanation")]))
    if cached:
        found = _look_up(stored(None), spark.read.parquet(cache), f"{work}/found")
    small = stored_bytes(spark, f"{work}/waiting") <= SMALL
    for i in [None] if small else range(PARTS):
        rows, own = stored(i), F.lit(True) if i is None else part_of("document_id") == i
        before = translate.resumable(old.filter(own), o.retry).repartition("document_id") if previous else None
        if cached:
            rows = rows.repartition("document_id")
            rows = translate.beside_old(rows, before) if previous else rows
        else:
            rows = made(rows, before)
        if previous:
            rows = translate.with_old(rows)
        if cached:
            rows = translate.with_cached(rows, found(i).repartition("document_id"))
        schema = _finish(rows, o, make_client, work)
        for gone in (f"{work}/waiting", f"{work}/found") if i in (None, PARTS - 1) else (places[i], f"{work}/found/_part={i}"):
            delete(spark, gone)
    return read_packed(spark, [f"{work}/blocks"], TEXTS, schema)


def _look_up(ready: DataFrame, cache: DataFrame, path: str) -> Callable[[int | None], DataFrame]:
    """Writes what the cache has for the keys of ready, one range of keys after the other; a function that reads a part of the documents, or with None all."""
    asked = ready.filter(~translate.retained(F.col("block_type"))).select("document_id", "block_id", "key")
    edges = ["4", "8", "c"]
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        within = lambda df, low=low, high=high: df.filter((F.col("key") >= low if low else F.lit(True)) & (F.col("key") < high if high else F.lit(True)))
        hits = translate.cache_lookup(within(asked), within(cache)).filter("cached is not null")
        hits.select("document_id", "block_id", "cached", part_of("document_id").alias("_part")).write.mode("append").option("compression", "zstd").partitionBy("_part").parquet(path)
    schema, spark = hits.select("document_id", "block_id", "cached").schema, ready.sparkSession

    def read(i: int | None) -> DataFrame:
        paths = [x for x in (f"{path}/_part={k}" for k in (range(PARTS) if i is None else [i])) if stored_bytes(spark, x)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    return read


def _finish(ready: DataFrame, o: Options, make_client, work: str) -> T.StructType:
    """Calls for ready's rows and appends what comes of it to the blocks under work; their schema."""
    is_retained = translate.retained(F.col("block_type"))
    if o.demo:
        called = ready.withColumns({"raw": F.when(~is_retained, translate.demo_raw(F.col("protected_text"))), "error": F.lit(None).cast("string"), "fatal": F.lit(False), "called": F.lit(False), "origin": F.when(is_retained, "retained").otherwise("demo")}).drop("user")
    else:
        given = F.when(is_retained, "retained")
        called = translate.call_provider(ready.withColumn("given", F.coalesce("given", given) if "given" in ready.columns else given), make_client, o.most_chars, together=True)
    schema = write_packed(called, f"{work}/called", TEXTS)
    settled = translate.settle(read_packed(ready.sparkSession, [f"{work}/called"], TEXTS, schema), o.demo)
    schema = write_packed(settled, f"{work}/blocks", TEXTS)
    delete(ready.sparkSession, f"{work}/called")
    return schema
