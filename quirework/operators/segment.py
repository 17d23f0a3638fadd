"""Lines to blocks: gaps and islands inside the extractor's own blocks, then one row for each block.

lines: document_id, page, native (block number of the extractor), line_no, text, x0, y0, x1, y1, dir_y, width and
height (of the page), fonts (array of struct size, chars). Order within a block is line_no.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip

ROTATED = "RotatedText: its place among the blocks is a guess"
OCR_DOCUMENT = "RequiresOCR: some pages hold too little text; what they have is used"
OCR_PAGE = "RequiresOCR: too little text to read"


def spans_to_lines(spans: DataFrame) -> DataFrame:
    """One row a line from one row a span, text joined in span order; raw blocks that aren't text (type other than 0) and blank lines are left out."""
    line = ("document_id", "page", "native", "line_no")
    joined = spans.filter(F.coalesce("type", F.lit(0)) == 0).groupBy(*line).agg(
        F.array_sort(F.collect_list(F.struct("span_no", "text", F.col("font_size").alias("size")))).alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("dir_y").alias("dir_y"), F.first("width").alias("width"), F.first("height").alias("height")
    )
    fonts = F.transform("parts", lambda p: F.struct(p["size"].alias("size"), F.length(p["text"]).alias("chars")))
    return joined.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), "")).withColumn("fonts", fonts).drop("parts").filter(~is_blank(F.col("text")))


def group_lines(lines: DataFrame) -> DataFrame:
    """Adds part: a new one begins where a line jumps sideways, back up, or down by more than the line before is high."""
    w = Window.partitionBy("document_id", "page", "native").orderBy("line_no")
    before = lambda c: F.lag(c).over(w)
    high = F.coalesce(F.array_max(F.transform(before("fonts"), lambda f: f["size"])), F.lit(10.0))
    breaks = (F.abs(F.col("x0") - before("x0")) > F.col("width") * 0.35) | (F.col("y0") < before("y0") - 3) | (F.col("y0") - before("y1") > high)
    full = lines.filter(~is_blank(F.col("text")))
    return full.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("part", F.sum("_new").over(w).cast("int")).drop("_new")


def build_blocks(grouped: DataFrame) -> DataFrame:
    """A row for each (document_id, page, native, part), in the extractor's order seq within the page."""
    key = ("document_id", "page", "native", "part")
    rows = grouped.groupBy(*key).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first("width").alias("width"), F.first("height").alias("height"),
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("lines"), F.flatten(F.collect_list("fonts")).alias("fonts"), F.bool_or(F.abs("dir_y") > 0.1).alias("rotated"),
    )
    text = strip(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    rotated = F.coalesce("rotated", F.lit(False))
    return rows.select(
        *key, F.format_string("p%04d-b%04d-%d", "page", "native", "part").alias("block_id"), (F.col("native").cast("long") * 100000 + F.col("part")).alias("seq"), "x0", "y0", "x1", "y1", "width", "height", text.alias("text"),
        F.when(rotated, 0.4).otherwise(0.85).alias("confidence"), F.when(rotated, F.array(F.lit(ROTATED))).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.array_max(F.transform("fonts", lambda f: f["size"])).alias("font_size"), "fonts",
    )


def ocr_flags(blocks: DataFrame) -> DataFrame:
    """document_id, page, letters, chars, broken and requires_ocr: too few letters and digits, or too many replacement characters."""
    sums = blocks.groupBy("document_id", "page").agg(
        F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]"))).alias("letters"), F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit("�"))).alias("broken")
    )
    return sums.withColumn("requires_ocr", (F.col("letters") < 20) | (F.col("broken") > F.greatest(F.lit(1.0), F.col("chars") * 0.1)))


def document_summary(blocks: DataFrame, pages: DataFrame, stems: DataFrame) -> DataFrame:
    """document_id, title (title blocks in order, else the file's stem) and warnings. blocks: with block_type, page, position. pages: requires_ocr. stems: document_id, stem."""
    titles = blocks.filter("block_type = 'title'").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "position", "text"))), lambda x: x["text"]), " ").alias("title"))
    ocr = pages.groupBy("document_id").agg(F.bool_or("requires_ocr").alias("ocr"))
    joined = stems.join(titles, "document_id", "left").join(ocr, "document_id", "left")
    return joined.select("document_id", F.coalesce(F.nullif("title", F.lit("")), "stem").alias("title"), F.when(F.col("ocr"), F.array(F.lit(OCR_DOCUMENT))).otherwise(F.array().cast("array<string>")).alias("warnings"))
