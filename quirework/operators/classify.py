"""Block types, repeated margins, current section and the reference list.

blocks: what reading_order returns; (page, position) is the document's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, word_count
from .layout import body_fonts

EQUATION = "EquationHeuristic: looks like an equation and stays untranslated"
# The words that make a heading, and the forms of captions and numbered headings.
HEADINGS = r"(?iu)^(?:\d+(?:\.\d+)*\.?\s+)?(?:abstract|introduction|background|related work|methods?|methodology|experiments?|results?|discussion|conclusions?|references|bibliography|acknowledg(?:e)?ments?|appendix)(?:\s.*)?$"
CAPTION = r"(?iu)^(?:Fig(?:ure)?\.?\s*\d+|Table\s+(?:\d+|[IVXLCDM]+))\b"
NUMBERED = r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s+[A-Z]"
REFERENCE_LIST = r"(?i)\b(references|bibliography)\b"
# End of the fixed values.


def block_type(body: Column) -> Column:
    text, size = strip(F.col("text")), F.coalesce("font_size", body)
    short = F.length(text) < 120
    like = lambda pattern: F.regexp_like(text, F.lit(pattern))
    # The first that holds decides.
    return (
        F.when(like(r"^\d+$") & (F.col("y0") > F.col("height") * 0.9), "footer")
        .when(like(CAPTION), "caption")
        .when(short & like(HEADINGS), "section_title")
        .when((F.col("page") == 1) & (size >= body * 1.4) & (F.col("y0") < F.col("height") * 0.3), "title")
        .when(short & (size >= body * 1.12), "section_title")
        .when(short & like(NUMBERED), "section_title")
        .when(text.startswith("$$") | text.startswith("\\[") | (text.contains("=") & short & (word_count(text) < 14)), "equation")
        .otherwise("paragraph")
    )


def with_types(blocks: DataFrame) -> DataFrame:
    """Adds block_type by the ordered rules, with the document's body font; lowers an equation's confidence and warns."""
    rows = blocks.drop("body").join(body_fonts(blocks, "document_id"), "document_id", "left").withColumn("body", F.coalesce("body", F.lit(10.0)))
    typed = rows.withColumn("block_type", block_type(F.col("body")))
    equation = F.col("block_type") == "equation"
    return typed.withColumn("confidence", F.when(equation, F.least("confidence", F.lit(0.65))).otherwise(F.col("confidence"))).withColumn("warnings", F.when(equation, F.array_append("warnings", F.lit(EQUATION))).otherwise(F.col("warnings")))


def signature(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\d+", "#")


def in_margin() -> Column:
    return F.when(F.col("y1") < F.col("height") * 0.07, "header").when(F.col("y0") > F.col("height") * 0.93, "footer")


def repeated_margins(blocks: DataFrame) -> DataFrame:
    """document_id, signature, pages: margin texts, digits aside, that stand on two or more pages."""
    found = blocks.filter(in_margin().isNotNull()).groupBy("document_id", signature(F.col("text")).alias("signature")).agg(F.countDistinct("page").alias("pages"))
    return found.filter("pages >= 2")


def with_margins(typed: DataFrame) -> DataFrame:
    repeats = repeated_margins(typed)
    rows = typed.withColumn("signature", signature(F.col("text"))).join(repeats, ["document_id", "signature"], "left")
    return rows.withColumn("block_type", F.coalesce(F.when(F.col("pages").isNotNull(), in_margin()), "block_type")).drop("signature", "pages")


def with_sections(typed: DataFrame) -> DataFrame:
    """Adds section, the nearest section title at or before the block ('' before the first), and makes what follows a references title a reference."""
    so_far = Window.partitionBy("document_id").orderBy("page", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.when(F.col("block_type") == "section_title", F.replace("text", F.lit("\n"), F.lit(" ")))
    rows = typed.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(so_far), F.lit("")))
    listed = F.regexp_like("section", F.lit(REFERENCE_LIST)) & ~F.col("block_type").isin("section_title", "header", "footer")
    return rows.withColumn("block_type", F.when(listed, "reference").otherwise(F.col("block_type")))


def classify(blocks: DataFrame) -> DataFrame:
    return with_sections(with_margins(with_types(blocks)))
