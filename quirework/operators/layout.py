"""Reading order of a page's blocks from their boxes.

blocks: document_id, page, seq (the extractor's order, the last tie-breaker everywhere), block_id, x0, y0, x1, y1,
width, height, text, font_size, fonts (array of struct size, chars), confidence, warnings. All work is partitioned by
(document_id, page), whose blocks are tens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW = "ReadingOrderUncertain: blocks stand side by side, but too few for columns"
OVERLAP = "ReadingOrderUncertain: a wide block and a column share a height"
PAGE = "ReadingOrderUncertain: compare the blocks with the page"
PAGE_KEY = ("document_id", "page")


def stratum() -> Column:
    """0 top margin, 1 body, 2 bottom margin."""
    return F.when(F.col("y1") < F.col("height") * 0.05, 0).when(F.col("y0") > F.col("height") * 0.94, 2).otherwise(1)


def side() -> Column:
    mid, tol = F.col("width") / 2, F.col("width") * 0.015
    return F.when((F.col("x1") <= mid + tol) & (F.col("x0") < mid - tol), "left").when(F.col("x0") >= mid - tol, "right").otherwise("span")


def column_sides(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("stratum", stratum()).withColumn("side", side())


def paired_pages(sided: DataFrame) -> DataFrame:
    """The pages on which a left block shares a height with a right one; touching counts."""
    body = sided.filter("stratum = 1")
    left = body.filter("side = 'left'").select(*PAGE_KEY, F.col("y0").alias("l0"), F.col("y1").alias("l1"))
    right = body.filter("side = 'right'").select(*PAGE_KEY, F.col("y0").alias("r0"), F.col("y1").alias("r1"))
    meets = F.least("l1", "r1") >= F.greatest("l0", "r0")
    on = [left[k] == right[k] for k in PAGE_KEY]
    return left.join(right, [*on, meets], "left_semi").select(*PAGE_KEY).distinct()


def layout_kinds(sided: DataFrame) -> DataFrame:
    """document_id, page, n_left, n_right, paired, kind (single_column, two_column or uncertain) before overlaps are looked at."""
    counts = sided.groupBy(*PAGE_KEY).agg(*(F.count_if((F.col("side") == s) & (F.col("stratum") == 1)).alias(f"n_{s}") for s in ("left", "right")))
    both = counts.join(paired_pages(sided).withColumn("paired", F.lit(True)), [*PAGE_KEY], "left").withColumn("paired", F.coalesce("paired", F.lit(False)))
    two = (F.col("n_left") >= 2) & (F.col("n_right") >= 2) & F.col("paired")
    return both.withColumn("kind", F.when(two, "two_column").when(F.col("paired"), "uncertain").otherwise("single_column"))


def body_fonts(blocks: DataFrame, *key: str) -> DataFrame:
    """key and body: the font size, to one decimal, with most characters; of equal ones the first seen."""
    each = blocks.select(*key, "page", "seq", F.posexplode("fonts").alias("at", "font")).select(*key, F.round("font.size", 1).alias("size"), F.col("font.chars").alias("chars"), F.struct("page", "seq", "at").alias("seen"))
    sums = each.groupBy(*key, "size").agg(F.sum("chars").alias("chars"), F.min("seen").alias("seen"))
    w = Window.partitionBy(*key).orderBy(F.desc("chars"), "seen")
    return sums.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*key, F.col("size").alias("body"))


def with_separators(sided: DataFrame, kinds: DataFrame) -> DataFrame:
    """On two-column pages, prominent short headings of the left column that stand above or below the whole right column count as spans."""
    page = Window.partitionBy(*PAGE_KEY)
    right = (F.col("side") == "right") & (F.col("stratum") == 1)
    fonts = body_fonts(sided.filter("stratum = 1"), *PAGE_KEY)
    rows = sided.join(kinds.select(*PAGE_KEY, "kind"), [*PAGE_KEY]).join(fonts, [*PAGE_KEY], "left").withColumn("body", F.coalesce("body", F.lit(10.0)))
    rows = rows.withColumn("_top", F.min(F.when(right, F.col("y0"))).over(page)).withColumn("_bottom", F.max(F.when(right, F.col("y1"))).over(page))
    apart = (F.col("y1") < F.col("_top")) | (F.col("y0") > F.col("_bottom"))
    heading = (F.col("stratum") == 1) & (F.col("kind") == "two_column") & (F.col("side") == "left") & (F.coalesce("font_size", "body") >= F.col("body") * 1.12) & (F.length("text") < 120) & apart
    return rows.withColumn("side", F.when(heading, "span").otherwise(F.col("side"))).drop("_top", "_bottom")


def span_overlaps(separated: DataFrame) -> DataFrame:
    """document_id, page, seq, times: how many warnings a block gets where a spanning block overlaps a column by more than 3 points; one for the span, one for the column block for each such span."""
    body = separated.filter("stratum = 1 and kind = 'two_column'")
    span = body.filter("side = 'span'").select(*PAGE_KEY, F.col("seq").alias("s_seq"), F.col("y0").alias("s0"), F.col("y1").alias("s1"))
    column = body.filter("side <> 'span'").select(*PAGE_KEY, F.col("seq").alias("c_seq"), F.col("y0").alias("c0"), F.col("y1").alias("c1"))
    met = span.join(column, [*PAGE_KEY]).filter(F.least("s1", "c1") - F.greatest("s0", "c0") > 3)
    spans = met.select(*PAGE_KEY, F.col("s_seq").alias("seq")).distinct().withColumn("times", F.lit(1).cast("long"))
    return spans.unionByName(met.groupBy(*PAGE_KEY, F.col("c_seq").alias("seq")).agg(F.count("*").alias("times")))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds layout (of the page) and position (from 0 on the page), and lowers confidence and adds warnings where the order is uncertain.

    Bands: a block belongs behind as many spans as start above it or level with it; within a band the left column comes first,
    then the right one, then the span that ends it. That closed form needs one window and no loop over spans.
    """
    sided = column_sides(blocks)
    kinds = layout_kinds(sided)
    rows = with_separators(sided, kinds)
    times = span_overlaps(rows)
    rows = rows.join(times, [*PAGE_KEY, "seq"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    page = Window.partitionBy(*PAGE_KEY)
    rows = rows.withColumn("layout", F.when((F.col("kind") == "two_column") & (F.max("times").over(page) > 0), "uncertain").otherwise(F.col("kind")))

    two = (F.col("kind") == "two_column") & (F.col("stratum") == 1)
    is_span = two & (F.col("side") == "span")
    by_height = Window.partitionBy(*PAGE_KEY, "stratum").orderBy("y0")
    above = F.sum(is_span.cast("int")).over(by_height.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.row_number().over(Window.partitionBy(*PAGE_KEY, "stratum", "_span").orderBy("y0", "seq")) - 1
    rows = rows.withColumn("_span", is_span).withColumn("_band", F.when(two, F.when(is_span, rank).otherwise(above)).otherwise(0))
    order = [F.col("stratum"), F.col("_band"), F.col("_span"), F.when(two & ~is_span, F.col("side") == "right").otherwise(False), F.col("y0"), F.when(F.col("stratum") == 1, F.col("x0")).otherwise(0.0), F.col("seq")]
    rows = rows.withColumn("position", (F.row_number().over(Window.partitionBy(*PAGE_KEY).orderBy(*order)) - 1).cast("long"))

    few = (F.col("kind") == "uncertain") & (F.col("stratum") == 1)
    most = F.when(few, 0.55).when(F.col("times") > 0, 0.5).otherwise(1.0)
    new = F.when(few, F.array(F.lit(FEW))).otherwise(F.array_repeat(F.lit(OVERLAP), F.col("times").cast("int")))
    return rows.withColumn("confidence", F.least("confidence", most)).withColumn("warnings", F.concat("warnings", new)).drop("_span", "_band", "times", "kind")


def page_warnings(ordered: DataFrame) -> DataFrame:
    """document_id, page, layout, warnings of the page."""
    return ordered.groupBy(*PAGE_KEY).agg(F.first("layout").alias("layout")).withColumn("warnings", F.when(F.col("layout") == "uncertain", F.array(F.lit(PAGE))).otherwise(F.array().cast("array<string>")))
