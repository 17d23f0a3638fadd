"""Explanations on demand: one block's request, and the check of what comes back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import bounded, with_context


def block(blocks: DataFrame, document_id, block_id: str) -> DataFrame:
    """The one row of a block; KeyError if there is none."""
    found = blocks.filter((F.col("document_id") == document_id) & (F.col("block_id") == block_id))
    if not found.limit(1).count():
        raise KeyError(block_id)
    return found


def lookup(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """asked (document_id, block_id) with found: whether there is such a block. block() for many at once, without an error."""
    known = blocks.select("document_id", "block_id").distinct().withColumn("found", F.lit(True))
    return asked.join(known, ["document_id", "block_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def requests(blocks: DataFrame, context_chars: int = 6000, most_chars: int = 16000) -> DataFrame:
    """document_id, block_id, too_long, the bounded context, text, translation and the first ten warnings of every block."""
    rows = bounded(with_context(blocks), context_chars, with_abstract=True)
    long = F.length("text") + F.length(F.coalesce("translation", F.lit(""))) > 2 * most_chars
    return rows.select("document_id", "block_id", long.alias("too_long"), "section", "terminology", "previous", "next", "abstract", "text", "translation", top_warnings(F.col("warnings")).alias("warnings"))


def top_warnings(warnings: Column, n: int = 10) -> Column:
    return F.slice(warnings, 1, n)


def unfenced(raw: Column) -> Column:
    """Without one code fence around the whole."""
    inner = F.regexp_replace(F.regexp_replace(raw, r"(?s)^[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    return F.when(raw.startswith("```") & raw.endswith("```"), F.trim(inner)).otherwise(raw)


def parsed(answers: DataFrame) -> DataFrame:
    """Adds explanation, null unless the answer is one JSON object with two non-empty strings and, if it names any, at most 30 terms of two strings each. answers: raw."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    part = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    strings = lambda v, *names: reduce(Column.__and__, [kind(part(v, n)) == "STRING" for n in names])
    # The parser stops behind the first value; as a list's only element and as a member's value the answer must end there.
    raw = unfenced(F.col("raw"))
    alone = F.try_parse_json(F.concat(F.lit('{"a":'), raw, F.lit("}"))).isNotNull()
    one = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    value = F.when(alone & F.try_variant_get(one, "$[1]", "variant").isNull(), F.try_variant_get(one, "$[0]", "variant"))
    rows = answers.withColumn("_v", value).withColumn("_terms", F.try_variant_get("_v", "$.key_terms", "array<variant>"))
    none = part(F.col("_v"), "key_terms").isNull()
    listed = kind(part(F.col("_v"), "key_terms")).startswith("ARRAY<") & (F.size("_terms") <= 30) & F.forall("_terms", lambda t: strings(t, "term", "explanation"))
    whole = strings(F.col("_v"), "plain_explanation", "role_in_paper") & (none | F.coalesce(listed, F.lit(False)))
    text = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    terms = F.transform(F.coalesce("_terms", F.array().cast("array<variant>")), lambda t: F.struct(text(t, "term").alias("term"), text(t, "explanation").alias("explanation")))
    found = F.struct(text("_v", "plain_explanation").alias("plain_explanation"), text("_v", "role_in_paper").alias("role_in_paper"), terms.alias("key_terms"))
    full = (F.length(found["plain_explanation"]) > 0) & (F.length(found["role_in_paper"]) > 0)
    return rows.withColumn("explanation", F.when(whole & full, found)).drop("_v", "_terms")
