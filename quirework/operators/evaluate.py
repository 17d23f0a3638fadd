"""Labels against predictions: validation, then micro-averaged metrics.

blocks: document_id, page, position, block_id, block_type, text, translation. page_labels: document_id, page,
reading_order_reviewed, segmentation_reviewed, segmentation_issues, expected_order. block_labels: document_id, block_id,
source_text_hash, expected_block_type, block_type_reviewed, protection_reviewed, expected_items, verdict, error_tags,
translation_hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_ratio, text_hash, translation_hash
from ..functions.tokens import scan

DOC = "document_id"


def sized(value: Column) -> Column:
    """Text behind its length, so that joined values can't run into each other."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def fingerprint(blocks: DataFrame, *box: str) -> DataFrame:
    """document_id, fingerprint: of ids, pages, boxes (to thousandths) and texts in the order of ids, whatever the order and the types of the blocks."""
    box_text = [sized(F.format_number(F.col(c), "0.000")) for c in box]
    line = F.concat(sized(F.col("block_id")), sized(F.col("page")), *box_text, sized(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("block_id", line.alias("line"))))
    return blocks.groupBy(DOC).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").cast("binary"), 256).alias("fingerprint"))


def draft_labels(blocks: DataFrame) -> DataFrame:
    """Block labels filled with the predictions, nothing reviewed yet."""
    items = F.transform(scan("text"), lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value"), t["start"].alias("start"), t["end"].alias("end")))
    return blocks.select(DOC, "block_id", text_hash(F.col("text")).alias("source_text_hash"), F.col("block_type").alias("expected_block_type"), F.lit(False).alias("block_type_reviewed"), F.lit(False).alias("protection_reviewed"), items.alias("expected_items"), F.lit("not_reviewed").alias("verdict"), F.array().cast("array<string>").alias("error_tags"), F.lit("").alias("translation_hash"))


def label_errors(blocks: DataFrame, block_labels: DataFrame) -> DataFrame:
    """document_id, block_id, error of block labels that no longer fit."""
    pred = blocks.select(DOC, "block_id", "text", F.coalesce("translation", F.lit("")).alias("translation"), F.lit(True).alias("in_blocks"))
    rows = pred.join(block_labels.withColumn("in_labels", F.lit(True)), [DOC, "block_id"], "full_outer")
    both = F.col("in_blocks") & F.col("in_labels")
    reviewed = both & (F.col("verdict") != "not_reviewed")
    stored = F.coalesce("translation_hash", F.lit(""))
    off = F.exists("expected_items", lambda i: (i["end"] > F.length("text")) | (F.substring("text", i["start"] + 1, i["end"] - i["start"]) != i["value"]))
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(both, F.lit(False)), F.lit("label and prediction are not of the same blocks")),
        F.when(both & (F.col("source_text_hash") != text_hash(F.col("text"))), F.lit("the source text is another")),
        F.when(both & F.coalesce(off, F.lit(False)), F.lit("a protected span is not in the text")),
        F.when(reviewed & (stored == ""), F.lit("a review without the hash of its translation")),
        F.when(reviewed & (stored != "") & (stored != translation_hash(F.col("translation"))), F.lit("the translation is another than the one reviewed")),
    ))
    return rows.select(DOC, "block_id", F.explode(errors).alias("error"))


def page_errors(blocks: DataFrame, page_labels: DataFrame) -> DataFrame:
    """document_id, page, error of page labels that no longer fit."""
    pred = blocks.groupBy(DOC, "page").agg(F.array_sort(F.collect_set("block_id")).alias("ids"))
    rows = pred.join(page_labels.select(DOC, "page", "expected_order"), [DOC, "page"], "full_outer")
    errors = F.array_compact(F.array(
        F.when(F.col("ids").isNull() | F.col("expected_order").isNull(), F.lit("label and prediction are not of the same pages")),
        F.when(F.size("expected_order") != F.size(F.array_distinct("expected_order")), F.lit("a block stands twice in the expected order")),
        F.when(F.array_sort(F.array_distinct("expected_order")) != F.col("ids"), F.lit("the expected order has other blocks than the page")),
    ))
    return rows.select(DOC, "page", F.explode(errors).alias("error"))


def document_errors(blocks: DataFrame, annotations: DataFrame, *box: str) -> DataFrame:
    """document_id, error of annotated documents without blocks, and of those whose blocks have another fingerprint. annotations: document_id, source_fingerprint."""
    rows = annotations.select(DOC, "source_fingerprint").join(fingerprint(blocks, *box), DOC, "left")
    wrong = F.when(F.col("fingerprint").isNull(), "no document of this id").when(~F.col("source_fingerprint").eqNullSafe(F.col("fingerprint")), "segmentation or text is another than the one annotated")
    return rows.select(DOC, wrong.alias("error")).filter("error is not null")


def workspace_errors(blocks: DataFrame, annotations: DataFrame, page_labels: DataFrame, block_labels: DataFrame, *box: str) -> DataFrame:
    """document_id, place (a block's id, a page, or ''), error: everything wrong with the labels of the annotated documents."""
    known = annotations.select(DOC).distinct()
    own = blocks.join(known, DOC, "left_semi")
    labels, pages = (x.join(known, DOC, "left_semi") for x in (block_labels, page_labels))
    found = blocks.select(DOC).distinct()
    there = lambda x: x.join(found, DOC, "left_semi")
    parts = (
        document_errors(own, annotations, *box).withColumn("place", F.lit("")),
        label_errors(own, there(labels)).withColumnRenamed("block_id", "place"),
        page_errors(own, there(pages)).withColumn("place", F.col("page").cast("string")),
    )
    return reduce(DataFrame.unionByName, [p.select(DOC, "place", "error") for p in parts])


def summary(name: str, blocks: DataFrame, annotations: DataFrame, page_labels: DataFrame, block_labels: DataFrame, *box: str) -> DataFrame:
    """One row of all metrics. Documents with any error are left out of all but the count of documents; their errors are warnings, in order. annotations: document_id, source_fingerprint, status."""
    errors = workspace_errors(blocks, annotations, page_labels, block_labels, *box)
    good = valid_only(annotations, errors)
    keep = lambda x: x.join(good.select(DOC), DOC, "left_semi")
    b, pages, labels = keep(blocks), keep(page_labels), keep(block_labels)

    def named(rows: DataFrame, **names: str) -> DataFrame:
        return rows.select(*[F.col(old).alias(new) for new, old in names.items()])

    def histogram(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    # A line for each document with errors: the report is as long as its errors are many.
    lines = errors.select(F.concat_ws(": ", F.col(DOC).cast("string"), F.when(F.col("place") != "", F.col("place")), "error").alias("line"))
    rows = [
        annotations.agg(F.lit(name).alias("dataset_name"), F.count("*").alias("documents")),
        good.agg(F.count_if(F.col("status") == "complete").alias("completed_documents")),
        named(order_pairs(b, pages), pages_reviewed="pages", reading_order_pair_accuracy="accuracy"),
        named(segmentation(pages), segmentation_pages_reviewed="reviewed", segmentation_issue_page_rate="rate"),
        histogram(issue_histogram(pages), "issue", "segmentation_issues"),
        named(type_accuracy(b, labels), block_types_reviewed="reviewed", block_type_accuracy="accuracy"),
        named(span_scores(b, labels), guard_precision="precision", guard_recall="recall", guard_f1="f1"),
        named(verdict_rates(labels), translations_reviewed="reviewed", translation_pass_rate="passed_rate", translation_acceptable_rate="acceptable_rate", translation_major_error_rate="major_rate"),
        histogram(tag_histogram(labels), "tag", "translation_error_tags"),
        lines.agg(F.sort_array(F.collect_list("line")).alias("warnings")),
    ]
    # One row each, with columns of its own: put together by what isn't null.
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows)
    return every.agg(*[F.any_value(c, ignoreNulls=True).alias(c) for c in every.columns])


def valid_only(rows: DataFrame, *errors: DataFrame) -> DataFrame:
    """Without the documents that any error names."""
    for e in errors:
        rows = rows.join(e.select(DOC).distinct(), DOC, "left_anti")
    return rows


def order_pairs(blocks: DataFrame, page_labels: DataFrame) -> DataFrame:
    """One row: pages, pairs, correct, accuracy over reviewed pages. A pair of expected blocks is correct if predicted in that order."""
    reviewed = page_labels.filter("reading_order_reviewed").select(DOC, "page", F.posexplode("expected_order").alias("rank", "block_id"))
    placed = reviewed.join(blocks.select(DOC, "page", "block_id", "position"), [DOC, "page", "block_id"], "left")
    a, b = (placed.select(DOC, "page", *[F.col(c).alias(f"{c}_{s}") for c in ("rank", "position")]) for s in "ab")
    pairs = a.join(b, [DOC, "page"]).filter("rank_a < rank_b")
    each = pairs.select(F.lit(0).alias("page"), F.lit(1).alias("pair"), F.coalesce(F.col("position_a") < F.col("position_b"), F.lit(False)).cast("int").alias("hit"))
    pages = page_labels.filter("reading_order_reviewed").select(F.lit(1).alias("page"), F.lit(0).alias("pair"), F.lit(0).alias("hit"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = each.union(pages).agg(total("page").alias("pages"), total("pair").alias("pairs"), total("hit").alias("correct"))
    return sums.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("pairs")))


def segmentation(page_labels: DataFrame) -> DataFrame:
    """One row: reviewed, with_issues, rate."""
    done = page_labels.filter("segmentation_reviewed").agg(F.count("*").alias("reviewed"), F.count_if(F.size("segmentation_issues") > 0).alias("with_issues"))
    return done.withColumn("rate", safe_ratio(F.col("with_issues"), F.col("reviewed")))


def issue_histogram(page_labels: DataFrame) -> DataFrame:
    return page_labels.filter("segmentation_reviewed").select(F.explode("segmentation_issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def type_accuracy(blocks: DataFrame, block_labels: DataFrame) -> DataFrame:
    rows = block_labels.filter("block_type_reviewed").join(blocks.select(DOC, "block_id", "block_type"), [DOC, "block_id"])
    sums = rows.agg(F.count("*").alias("reviewed"), F.count_if(F.col("expected_block_type") == F.col("block_type")).alias("correct"))
    return sums.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("reviewed")))


def span_scores(blocks: DataFrame, block_labels: DataFrame) -> DataFrame:
    """One row: predicted, expected, hits, precision, recall, f1 of protected spans, micro-averaged over reviewed blocks; the scanner runs again on their texts."""
    rows = block_labels.filter("protection_reviewed").join(blocks.select(DOC, "block_id", "text"), [DOC, "block_id"])
    return span_sums(rows.select(scan("text").alias("found"), "expected_items"))


def span_sums(rows: DataFrame) -> DataFrame:
    """span_scores of rows with found and expected_items."""
    same = lambda c: F.array_distinct(F.transform(c, lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value"), t["start"].alias("start"), t["end"].alias("end"))))
    p, e = same(F.col("found")), same(F.col("expected_items"))
    sums = rows.agg(F.coalesce(F.sum(F.size(p)), F.lit(0)).alias("predicted"), F.coalesce(F.sum(F.size(e)), F.lit(0)).alias("expected"), F.coalesce(F.sum(F.size(F.array_intersect(p, e))), F.lit(0)).alias("hits"))
    return with_f1(sums)


def with_f1(sums: DataFrame) -> DataFrame:
    rates = sums.withColumn("precision", safe_ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", safe_ratio(F.col("hits"), F.col("expected")))
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1", F.when(both.isNull(), None).when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def verdict_rates(block_labels: DataFrame) -> DataFrame:
    """One row: reviewed, and the rates of passed, acceptable (passed or minor) and major (major or unusable) translations."""
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    sums = block_labels.filter("verdict <> 'not_reviewed'").agg(F.count("*").alias("reviewed"), n("pass").alias("passed"), n("pass", "minor_error").alias("acceptable"), n("major_error", "unusable").alias("major"))
    return sums.select("reviewed", *[safe_ratio(F.col(c), F.col("reviewed")).alias(f"{c}_rate") for c in ("passed", "acceptable", "major")])


def tag_histogram(block_labels: DataFrame) -> DataFrame:
    return block_labels.filter("verdict <> 'not_reviewed'").select(F.explode("error_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def new_documents(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Entries whose document the manifest doesn't have yet."""
    return entries.join(manifest.select(DOC), DOC, "left_anti")
