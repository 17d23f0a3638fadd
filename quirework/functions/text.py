"""Text expressions with Python's idea of white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, with the four information separators that Java leaves out.
BLANK = r"[\p{IsWhite_Space}\x1C-\x1F]"


def strip(text: Column) -> Column:
    """Without white space at either end; a run inside is tried once, however long it is."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(BLANK), F.regexp_replace(text, f"^{BLANK}++|(?<!{BLANK}){BLANK}++$", "")).otherwise(text)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{BLANK[1:-1]}]")


def word_count(text: Column) -> Column:
    return F.when(is_blank(text), 0).otherwise(F.size(F.split(strip(text), f"{BLANK}+")))


def html_escape(text: Column) -> Column:
    out = text
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def content_id(content: Column) -> Column:
    """A document's id: the first 20 hex digits of its bytes' SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 20)


def text_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def translation_hash(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(text_hash(text))


def safe_ratio(over: Column, under: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.when(under != 0, over / under)
