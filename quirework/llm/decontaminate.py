"""Benchmark decontamination by winnowing.

Texts are cut into words. Of every ``window - k + 1`` consecutive k-grams the one with the least hash is an anchor, so
two texts that share ``window`` consecutive words share the anchor of that span: no long shared span is missed. The
anchors of documents are joined with those of the benchmark; where they meet, every window of words around the anchor
is compared with the benchmark's windows. An item with fewer words than a window is one window of its own length,
looked up by all grams of that length.

DataFrame expressions only. A document is read once and never shuffled: its grams are tried with a table of bits of
fixed size first, so hardly any but those of the benchmark become rows; each carries the word hashes around it to the
join. Benchmark tables are broadcast only behind a count and a sum of bytes; beyond it the same few rows are shuffled.

Defined results: a null or empty text has no words; an item without words has no window. A text of any length is one
row's work, in memory of some 50 bytes a word. Rows alike in doc_id (null or not) and text are one document, with one
row; rows with one id and different texts are documents of their own. Rows with one item_id are windows of one item. Empty tables give documents
without hits, or no rows. Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, evaluated, grams_of, let, materialised, row_key, small_side, tidied, upto, words_of

#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5
#: Bits of the table that grams of documents are tried with before the join.
MOST_BITS = 1 << 24

SEEDS = "array<struct<m:int,g:bigint,s:int,around:array<bigint>>>"


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(ascii_lower(text), WORD), lambda w: F.xxhash64(w))


def anchors(h: Column, window: int, k: int, visit, wanted=None) -> Column:
    """visit(gram, place) for each k-gram that is the least of some window; equal least ones all count. wanted: a test that a gram has to pass, tried first."""
    span = window - k + 1

    def of(g: Column) -> Column:
        def is_least(j: Column) -> Column:
            found = F.lit(False)
            for start in (j - d for d in range(span)):
                inside = (start >= 0) & (start + span <= F.size(g))
                found = found | (inside & (F.get(g, j) == F.least(*[F.get(g, start + d) for d in range(span)])))
            return found

        tried = upto(F.size(g)) if wanted is None else F.filter(upto(F.size(g)), lambda j: wanted(F.get(g, j)))
        return F.transform(F.filter(tried, is_least), lambda j: visit(F.get(g, j), j))

    return F.when(F.size(h) >= window, let(grams_of(h, k), of))


def bit_test(seeds: DataFrame, most_bits: int):
    """A test that every gram of seeds (column g) passes, and of others one in thirty-two at most, as long as most_bits allows 32 bits a seed.

    It reads one bit of an array, which is all that comes to the driver: most_bits / 64 numbers at most, whatever the
    number of seeds. With more seeds more other grams pass, and are left to the join.
    """
    bits = min(most_bits, 1 << max(12, (32 * seeds.count()).bit_length()))
    long = lambda v: F.lit(v).cast("long")
    word = lambda g: F.shiftrightunsigned(g.bitwiseAND(long(bits - 1)), 6).cast("int")
    place = lambda g: g.bitwiseAND(long(63)).cast("int")
    set_bits = seeds.select(word(F.col("g")).alias("word"), F.call_function("shiftleft", long(1), place(F.col("g"))).alias("bit"))
    every = seeds.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), long(0).alias("bit"))
    words = set_bits.union(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    row = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.array_join(F.transform("w", lambda x: x["bits"].cast("string")), ",")).first()
    table = F.split(F.lit(row[0]), ",").cast("array<bigint>")  # folded to one constant of the plan
    return lambda g: F.call_function("shiftright", F.get(table, word(g)), place(g)).bitwiseAND(long(1)) == 1


def seed(m, g: Column, s: Column, around: Column) -> Column:
    return F.struct(m.alias("m"), g.alias("g"), s.alias("s"), around.alias("around"))


def document_seeds(h: Column, short: list[int], window: int, k: int, wanted) -> Column:
    """The places that pass wanted. m: the length of the window sought. s: where around, or a short window, starts."""
    none = F.lit(None).cast("array<bigint>")

    def visit(g: Column, j: Column) -> Column:
        start = F.greatest(F.lit(0), j - (window - k))
        return seed(F.lit(window), g, start, F.slice(h, start + 1, j + window - start))

    def whole(m: int) -> Column:
        return F.filter(F.transform(grams_of(h, m), lambda g, i: seed(F.lit(m), g, i, none)), lambda x: wanted(x["g"]))

    return F.concat(F.coalesce(anchors(h, window, k, visit, wanted), F.array().cast(SEEDS)), *map(whole, short))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(hits, windows). hits: doc_id (with a hash of the text), n_words and, for each place where a window of the benchmark occurs, start, m (its length) and w (its hash); a document without any has one row with nulls. windows: m, w, item_id.

    docs: doc_id, text. benchmark: item_id, text.
    """
    items = materialised(benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).filter(F.size("h") > 0), "items")
    n = F.least(F.size("h"), F.lit(window))
    # At most window - 1 different lengths come to the driver.
    short = sorted(r[0] for r in items.filter(F.size("h") < window).select(F.size("h")).distinct().collect())
    grams = F.when(F.size("h") >= window, grams_of(F.col("h"), window))
    for m in short:
        grams = F.when(F.size("h") == m, grams_of(F.col("h"), m)).otherwise(grams)
    windows = materialised(items.select("item_id", n.alias("m"), F.explode_outer(grams).alias("w")).filter(F.col("w").isNotNull()).distinct(), "windows")
    gathered = items.filter(F.size("h") >= window).select(F.explode_outer(anchors(F.col("h"), window, k, lambda g, j: g)).alias("g")).filter(F.col("g").isNotNull()).select(F.lit(window).alias("m"), "g")
    seeds = materialised(gathered.union(windows.filter(F.col("m") < window).select("m", F.col("w").alias("g"))).distinct(), "seeds")

    # One row without a seed stands for the document itself, dealt out by its id.
    own = F.array(seed(F.lit(0), F.xxhash64("doc_id"), F.lit(0), F.lit(None).cast("array<bigint>")))
    hashed = evaluated(docs.select(row_key().alias("doc_id"), word_hashes(F.col("text")).alias("h")))
    sown = hashed.select("doc_id", F.size("h").cast("long").alias("n_words"), F.concat(own, document_seeds(F.col("h"), short, window, k, bit_test(seeds, most_bits))).alias("seeds"))
    rows = sown.select("doc_id", "n_words", F.explode_outer("seeds").alias("x")).select("doc_id", "n_words", "x.*")
    met = rows.join(small_side(seeds.withColumn("met", F.lit(True))), ["m", "g"], "left").filter(F.col("met") | (F.col("m") == 0))
    spread = F.when(F.col("m") == window, F.transform(grams_of(F.col("around"), window), lambda w, i: F.struct(w.alias("w"), (F.col("s") + i).alias("start")))).otherwise(F.array(F.struct(F.col("g").alias("w"), F.col("s").alias("start"))))
    tried = met.select("doc_id", "n_words", "m", F.explode_outer(spread).alias("x")).select("doc_id", "n_words", "m", "x.w", "x.start")
    known = small_side(materialised(windows.select("m", "w").distinct().withColumn("found", F.lit(True)), "known"))
    hit = tried.join(known, ["m", "w"], "left").filter(F.col("found") | (F.col("m") == 0))
    blank = lambda c: F.when(F.col("m") > 0, F.col(c)).alias(c)
    return materialised(hit.select("doc_id", "n_words", blank("start"), blank("w"), blank("m")).distinct(), "hits"), windows


def covered(spans: Column) -> Column:
    """Words in the union of sorted (start, m) spans."""
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["start"] + x["m"] - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], x["start"] + x["m"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])


@tidied
def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit (words inside windows of the benchmark), items (sorted ids as strings), contaminated: a row for each doc_id and text."""
    hits, windows = find_hits(docs, benchmark, window, k)
    spans = F.sort_array(F.collect_set(F.when(F.col("w").isNotNull(), F.struct("start", "m"))))
    counted = hits.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), covered(spans).cast("long").alias("n_hit"))
    pairs = hits.filter(F.col("w").isNotNull()).select("doc_id", "m", "w").distinct().join(windows, ["m", "w"]).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    same = counted["doc_id"].eqNullSafe(pairs["doc_id"])
    joined = counted.join(pairs, same, "left").select(counted["doc_id"], "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return joined.withColumn("doc_id", F.col("doc_id.id")).withColumn("contaminated", F.col("n_hit") > 0)
