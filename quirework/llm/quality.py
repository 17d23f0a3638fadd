"""Quality rules, line first: lines that look like navigation, boilerplate, noise or broken text go, then documents that lose too much.

Rules of a line with a word: separators (menus), symbols, shouting, boilerplate phrases in short lines, and missing
closing punctuation in short lines. Beside them stand base rules on the whole text: too few words, too many repeated
five-word windows. All of it is DataFrame expressions on one row; nothing is shuffled.

Defined results: a null or empty text has no words and fails the base rules. A text of any length is judged whole, in
memory of some 100 bytes a word. Repeated rows, and rows that share an id, are judged row by row. An empty table gives
an empty result. Further columns don't matter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, evaluated, let, upto, words_of

SYMBOLS = r"[#*$%&|<>]"
#: Phrases of footers, consent banners and menus, in four languages.
BOILERPLATE = (
    "all rights reserved", "copyright", "©", "cookie", "privacy policy", "terms of (?:use|service)", "click here", "read more", "sign (?:up|in)", "log ?in", "subscribe", "share (?:this|on)", "javascript", "licensed under",
    "tous droits réservés", "politique de confidentialité", "cliquez ici", "lire la suite", "alle rechte vorbehalten", "datenschutz", "impressum", "hier klicken", "weiterlesen", "todos los derechos reservados", "política de privacidad", "haga clic", "leer más",
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost", "cleaned", "base_failed", "kept")


class LineRules(NamedTuple):
    """Shares are of a line's characters. most_lost: the share of a text's line characters that may go. short: a line of at most so many characters is tried for boilerplate; tiny: one of at most so many for its closing punctuation."""

    separators: float = 0.05
    symbols: float = 0.10
    shouting: float = 0.10
    short: int = 200
    tiny: int = 40
    most_lost: float = 0.5


def has_word(line: Column) -> Column:
    return F.regexp_like(line, F.lit(f"[^{SPACE}]"))


def fails(line: Column, r: LineRules) -> Column:
    n = F.length(line)
    share = lambda pattern: (n - F.length(F.regexp_replace(line, pattern, ""))) / n
    boiler = (n <= r.short) & F.regexp_like(line, F.lit("(?iu)" + "|".join(BOILERPLATE)))
    loose = (n <= r.tiny) & ~F.regexp_like(line, F.lit(rf"[.!?…。！？:;,)\]\"'»”’][{SPACE}]*$"))
    return (share("[|•·»›]") > r.separators) | (share(SYMBOLS) > r.symbols) | (share("!") > r.shouting) | boiler | loose


def repeat_words(words: Column, k: int = 5) -> Column:
    """Words in windows of k words that the text has twice or more, the first included. Windows are told apart by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = let(ranked, lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        step = lambda acc, p: F.struct((acc["n"] + k - F.greatest(F.lit(0), acc["end"] - p)).alias("n"), (p + k).alias("end"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])

    def of(h: Column) -> Column:
        grams = F.transform(upto(F.size(h) - (k - 1)), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measured(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs with, in place of columns of those names, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), lost (share of line characters), cleaned (the text without failed lines), base_failed and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = words_of(text), F.split(text, "\n")

    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words"))

    def by_lines(x: Column) -> Column:
        full = F.filter(x, has_word)
        dup = let(full, lambda f: F.size(f) - F.size(F.array_distinct(f)))
        good = F.filter(x, lambda line: ~has_word(line) | ~fails(line, rules))
        chars = lambda a: F.length(F.array_join(a, ""))
        return let(good, lambda g: F.struct(dup.cast("long").alias("n_dup_lines"), F.coalesce(1 - chars(g) / F.nullif(chars(x), F.lit(0)), F.lit(0.0)).alias("lost"), F.array_join(g, "\n").alias("cleaned")))

    own = F.struct(*[c for c in docs.columns if c not in MEASURES])
    found = docs.select(own.alias("_doc"), let(words, by_words).alias("_w"), let(lines, by_lines).alias("_l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    flat = evaluated(found).select("_doc.*", "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.lost", "_l.cleaned")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return flat.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("lost") <= rules.most_lost))


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The columns of docs, without the documents that the rules reject and, in those that stay, without the lines that failed."""
    own = measured(docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text")), "_text", rules)
    kept = evaluated(own.select("_doc", "cleaned", "kept")).filter("kept")
    return kept.select(*[F.col("cleaned").alias(c) if c == "text" else F.length("cleaned").cast("long").alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in docs.columns])
