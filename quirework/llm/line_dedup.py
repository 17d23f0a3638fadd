"""Line dedup by a segment-partition edit join.

A line goes if an equal line, or one within ``max_edits`` edits, first stands earlier in the corpus. Equal lines meet by
a 128-bit hash, so everything after that works on distinct lines. Two lines within e edits agree in one of e + 1
segments of the shorter one: every line is indexed by its segments, with its length, and probes the indexes of all
lengths from its own down to e less with the few substrings that can match. Pairs that meet are verified by bit-parallel
edit distance on a band of 2e + 1 diagonals.

A segment that very many distinct lines share would make a pair for every two of them. The lines of such a bucket are
taken without that segment, and what is left of them is cut into e + 1 segments again, and so on while buckets stay
crowded: lines within e edits are within e edits without a segment they share. In the end at most e characters are left
of each line, at the same place of otherwise equal lines; all of those are within e edits of each other, and each is
paired with the first alone. So a bucket of any size makes rows in proportion to its lines, and a line makes them in
proportion to the logarithm of its length for each place that it shares with a crowd. Every pair found, by whatever
bucket, is verified on the whole lines before anything goes.

DataFrame expressions only. Lines shorter than ``least`` characters are never near an earlier line; those of
``exact_least`` characters and more (by default ``least``; 1 for every line with a word) still go if an earlier line
equals them. Blank lines stay. Lines are compared without the white space around them.

Defined results: a null or empty text has one empty line. Order is (doc_id, line), a null doc_id first; rows with one id
and different texts are documents of their own, in the order of a hash. Rows alike in both are one document given
several times: a line is no repeat of itself there. A line of any length is compared
whole, in time and memory proportional to it. An empty table gives no rows. The columns of documents that aren't named
here stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, evaluated, let, materialised, row_key, tidied, upto

LEAST, MAX_EDITS = 24, 1
#: Lines of a bucket above which they are segmented again instead of paired.
CROWD = 40


def segment(n: Column, i: int, e: int) -> tuple[Column, Column]:
    """0-based start and length of segment i of a line of n characters: the last n mod (e + 1) segments are one longer."""
    size, longer = F.floor(n / (e + 1)).cast("int"), (n % (e + 1)).cast("int")
    short = F.lit(e + 1) - longer
    return i * size + F.greatest(F.lit(0), i - short), size + F.when(F.lit(i) >= short, 1).otherwise(0)


def segment_keys(line: Column, n: Column, e: int) -> Column:
    """array<struct<key, own, delta, at, size>>: an entry of the line's own segments (own) or a probe of those of lines that are delta shorter, and the part of the line that it stands for."""
    out = []
    for delta in range(e + 1):
        m = n - delta
        for i in range(e + 1):
            start, size = segment(m, i, e)
            # 1-based segment numbers make the published bounds for the shift of a match.
            for shift in range(max(-i, delta - (e - i)), min(i, delta + (e - i)) + 1):
                key = F.xxhash64(F.lit(i), m, F.substring(line, start + shift + 1, size))
                out.append(F.struct(key.alias("key"), F.lit(delta == 0 and shift == 0).alias("own"), F.lit(delta).alias("delta"), (start + shift).cast("int").alias("at"), size.cast("int").alias("size")))
    return F.array(*out)


def edits_at_most(a: Column, b: Column, e: int) -> Column:
    """Whether strings a and b are within e edits: bit vectors of vertical differences on the band of 2e + 1 diagonals, a column for each character of b."""
    width = 2 * e + 1
    band = (1 << width) - 1
    long = lambda v: F.lit(v).cast("long")

    def run(s: Column) -> Column:
        p, t = s["p"], s["t"]

        def step(acc: Column, j: Column) -> Column:
            same = None
            for k in range(width):
                bit = F.when(F.get(p, j - e + k) == F.get(t, j), long(1 << k)).otherwise(long(0))
                same = bit if same is None else same.bitwiseOR(bit)

            def diagonal(x: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                carried = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp)
                return let(carried.bitwiseOR(x).bitwiseOR(vn).bitwiseAND(long(band)), down)

            def down(d: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(long(band))
                hn = d.bitwiseAND(vp)
                moved = F.shiftright(d, 1)
                return let(hp, lambda h: F.struct(
                    hn.bitwiseOR(F.bitwise_not(moved.bitwiseOR(h))).bitwiseAND(long(band)).alias("vp"),
                    moved.bitwiseAND(h).alias("vn"),
                    (acc["score"] + F.when(d.bitwiseAND(long(1 << (width - 1))) == 0, 1).otherwise(0)).alias("score"),
                ))

            return let(same, diagonal)

        start = F.struct(long(band & ~((1 << e) - 1)).alias("vp"), long(0).alias("vn"), F.lit(e).alias("score"))
        below = F.size(p) - F.size(t) + e
        rows = long((1 << (2 * e)) - 1)
        end = lambda acc: acc["score"] - F.bit_count(acc["vp"].bitwiseAND(rows).bitwiseAND(hidden)) + F.bit_count(acc["vn"].bitwiseAND(rows).bitwiseAND(hidden))
        hidden = F.bitwise_not(F.call_function("shiftleft", long(1), below) - 1)
        return F.aggregate(upto(F.size(t)), start, step, end) <= e

    near = F.abs(F.length(a) - F.length(b)) <= e
    return near & F.when(F.length(b) == 0, F.length(a) <= e).otherwise(let(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t")), run))


def shortest_of(least: int, exact_least: int | None) -> int:
    """The characters of the shortest lines that are looked at; blank lines never are."""
    return least if exact_least is None else max(1, min(least, exact_least))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """row, at (line number), line (trimmed), n (its characters), h1, h2: the lines that can go. docs: row, text."""
    cut = docs.select("row", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).select("row", "at", trimmed(F.col("line")).alias("line"))
    return evaluated(cut.select("row", "at", "line", F.length("line").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"))).filter(F.col("n") >= least)


def without_part(text: Column, at: Column, size: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + size + 1, F.length(text)))


def deeper_keys(e: int) -> Column:
    """array<struct<key, own, delta, at, size>> for entries (bucket, own, delta, rest): where the rest is cut next, for an index entry (own) and for a probe of lines that are delta shorter."""
    rest, n, delta, own = F.col("rest"), F.length("rest"), F.col("delta"), F.col("own")
    m, out = n - delta, []

    def entry(fits: Column, kind: Column, place: Column, at: Column, size: Column, index: Column) -> None:
        key = F.xxhash64("bucket", kind, m, place, F.substring(rest, at + 1, size))
        out.append(F.when(fits, F.struct(key.alias("key"), index.alias("own"), delta.alias("delta"), at.cast("int").alias("at"), size.cast("int").alias("size"))))

    for i in range(e + 1):
        start, size = segment(m, i, e)
        for shift in range(-e, e + 1):
            bounds = [(d, max(-i, d - (e - i)) <= shift <= min(i, d + (e - i))) for d in range(e + 1)]
            fits = delta.isin([d for d, ok in bounds if ok]) if any(ok for _, ok in bounds) else None
            if fits is not None:
                entry(fits & (m > e), F.lit("segment"), F.lit(i), start + shift, size, own & F.lit(shift == 0))
    # Rests of at most e characters beside longer probes: some character of the shorter must stand in the longer.
    for p in range(e):
        entry(own & (n <= e) & (n > p), F.lit("character"), F.lit(p), F.lit(p), F.lit(1), F.lit(True))
        for q in range(max(0, p - e), p + e + 1):
            entry(~own & (m <= e) & (m > p) & (n > e) & (n > q), F.lit("character"), F.lit(p), F.lit(q), F.lit(1), F.lit(False))
    return F.array_compact(F.array(*out))


def met_pairs(members: DataFrame) -> DataFrame:
    """x, y (x less than y): pairs of an index entry with another entry of its bucket. members: key, own, h1, h2."""
    x, y = (members.select("key", F.col("own").alias(f"own_{s}"), F.struct("h1", "h2").alias(s)) for s in "xy")
    met = x.filter("own_x").join(y, "key").filter((~F.col("own_y") & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def crowded_pairs(members: DataFrame, texts: DataFrame, e: int, crowd: int) -> DataFrame:
    """x, y: pairs of lines of crowded buckets, so that every line within e edits of an earlier one there is paired with the first such. members: key, h1, h2. texts: h1, h2, first, line."""
    place = lambda df: df.select(F.monotonically_increasing_id().alias("entry"), "*")
    lines = members.distinct().join(texts, ["h1", "h2"])
    cuts = F.filter(segment_keys(F.col("line"), F.length("line"), e), lambda k: k["key"] == F.col("key"))
    cut = lines.select("h1", "h2", "first", "line", F.explode(cuts).alias("k")).select("h1", "h2", "first", "k.*", without_part(F.col("line"), F.col("k.at"), F.col("k.size")).alias("rest"))
    entries = materialised(place(cut.select(F.col("key").alias("bucket"), "own", "delta", "h1", "h2", "first", "rest").distinct()), "entries")
    found = []
    while not entries.isEmpty():
        # All short rests of a bucket are within e edits of each other: pairs with the first are enough.
        short = entries.filter(F.length("rest") <= e)
        leads = materialised(short.groupBy("bucket").agg(F.min(F.struct("first", "h1", "h2")).alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n"), "leads")
        one, two = F.struct("lead.h1", "lead.h2"), F.struct("h1", "h2")
        found.append(materialised(short.join(leads, "bucket").filter(one != two).select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).distinct(), "stars"))
        keyed = entries.select("entry", "h1", "h2", F.explode(deeper_keys(e)).alias("k")).select("entry", "h1", "h2", "k.*")
        counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("indexed")).filter("n > 1 and indexed > 0")
        shared = materialised(counts.select("key", (F.col("n") > crowd).alias("crowded")), "buckets")
        members = materialised(keyed.join(shared, "key"), "members")
        found.append(materialised(met_pairs(members.filter("not crowded")), "pairs"))
        again = members.filter("crowded").drop("h1", "h2", "crowded").join(entries.drop("own", "delta", "bucket"), "entry")
        entries = materialised(place(again.select(F.col("key").alias("bucket"), "own", "delta", "h1", "h2", "first", without_part(F.col("rest"), F.col("at"), F.col("size")).alias("rest")).distinct()), "entries")
    return reduce(DataFrame.union, found) if found else met_pairs(entries.select(F.col("bucket").alias("key"), "own", "h1", "h2"))


def line_classes(docs: DataFrame, max_edits: int = MAX_EDITS, least: int = LEAST, crowd: int = CROWD, exact_least: int | None = None) -> DataFrame:
    """h1, h2, first (row and at where the line first stands), near (the same of the first line within max_edits that stands earlier, or null): of lines that stand twice or have such a line. docs: row, text."""
    e, shortest = max_edits, shortest_of(least, exact_least)
    lines = lines_of(docs, shortest)
    keys = F.transform(segment_keys(F.col("line"), F.col("n"), e), lambda k: F.struct(k["key"].alias("key"), k["own"].alias("own")))
    if shortest < least:  # shorter lines have no keys, so they meet no other line
        keys = F.when(F.col("n") >= least, keys).otherwise(F.array().cast("array<struct<key:bigint,own:boolean>>"))
    place = F.struct("row", "at")
    distinct = materialised(lines.select("h1", "h2", place.alias("place"), keys.alias("keys")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("times"), F.first("keys").alias("keys")), "lines")
    dealt = distinct.select("h1", "h2", F.explode("keys").alias("k")).select("h1", "h2", "k.key", "k.own")
    counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.count_if("own").alias("indexed")).filter("n > 1 and indexed > 0")
    shared = materialised(counts.select("key", (F.col("n") > crowd).alias("crowded")), "buckets")
    members = materialised(dealt.join(shared, "key"), "members")
    pairs = materialised(met_pairs(members.filter("not crowded")), "pairs")

    wanted = pairs.select("x.*").union(pairs.select("y.*")).union(members.filter("crowded").select("h1", "h2")).distinct()
    wanted = distinct.join(materialised(wanted, "wanted"), ["h1", "h2"]).select("h1", "h2", "first")
    at_rows = materialised(wanted.groupBy("first.row").agg(F.collect_list(F.struct("h1", "h2", "first")).alias("lines")), "wanted_rows")
    pick = let(F.split(F.coalesce("text", F.lit("")), "\n"), lambda a: F.transform("lines", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["first"].alias("first"), trimmed(F.get(a, w["first"]["at"])).alias("line"))))
    texts = docs.join(at_rows.hint("merge"), "row").select(F.explode_outer(pick).alias("l")).select("l.*").filter(F.xxhash64("line") == F.col("h1"))
    texts = materialised(texts.dropDuplicates(["h1", "h2"]), "texts")
    pairs = pairs.union(crowded_pairs(members.filter("crowded").select("key", "h1", "h2"), texts, e, crowd)).distinct()

    a, b = (texts.select(F.struct("h1", "h2").alias(s), F.col("first").alias(f"first_{s}"), F.col("line").alias(f"line_{s}")) for s in "xy")
    linked = pairs.join(a, "x").join(b, "y").filter(edits_at_most(F.col("line_x"), F.col("line_y"), e))
    later = F.when(F.col("first_x") < F.col("first_y"), F.struct(F.col("y").alias("id"), F.col("first_x").alias("first"))).otherwise(F.struct(F.col("x").alias("id"), F.col("first_y").alias("first")))
    found = linked.select(later.alias("l")).select("l.id.h1", "l.id.h2", "l.first")
    near = materialised(found.groupBy("h1", "h2").agg(F.min("first").alias("near")), "near")
    return materialised(distinct.select("h1", "h2", "first", "times").join(near, ["h1", "h2"], "left").filter("times > 1 or near is not null").drop("times"), "line_classes")


@tidied
def decisions(docs: DataFrame, max_edits: int = MAX_EDITS, least: int = LEAST, crowd: int = CROWD, exact_least: int | None = None) -> DataFrame:
    """row, exact, near (arrays of line numbers that go, and why) of documents that lose lines. docs: doc_id, text."""
    own = docs.select(row_key().alias("row"), "text")
    classes = line_classes(own, max_edits, least, crowd, exact_least)
    place = F.struct("row", "at")
    gone = lines_of(own, shortest_of(least, exact_least)).select("row", "at", "h1", "h2").join(classes, ["h1", "h2"]).filter(F.col("near").isNotNull() | (place > F.col("first")))
    why = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("at"))))
    return materialised(gone.groupBy("row").agg(why(F.col("near").isNull() | (place > F.col("first"))).alias("exact"), why(F.col("near").isNotNull() & ~(place > F.col("first"))).alias("near")), "decisions")


@tidied
def dedup_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, removed (line numbers from 0, sorted): a row for each row of docs."""
    lines = docs.select(row_key().alias("row"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    # Decisions grow with the corpus: sorted and merged at every size, never broadcast.
    out = lines.join(decisions(docs.select("doc_id", "text"), **options).hint("merge"), "row", "left")
    exact, near = F.coalesce("exact", none), F.coalesce("near", none)
    return out.select(F.col("row.id").alias("doc_id"), "n_lines", F.size(exact).cast("long").alias("n_exact"), F.size(near).cast("long").alias("n_near"), F.array_sort(F.concat(exact, near)).alias("removed"))


@tidied
def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The columns of docs, without the lines that go, and without the documents that have no word left because of it."""
    found = decisions(docs.select("doc_id", "text"), **options).select("row", F.concat("exact", "near").alias("gone"))
    own = docs.select(row_key().alias("row"), "text", F.struct("*").alias("doc"))
    out = own.join(found.hint("merge"), "row", "left")
    left = F.array_join(let(F.col("gone"), lambda gone: F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))), "\n")
    cut = evaluated(out.select("doc", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("left")))
    stay = cut.filter(F.col("gone").isNull() | F.regexp_like("left", F.lit(f"[^{SPACE}]")))
    return stay.select(*[F.col("left").alias(c) if c == "text" else F.length("left").cast("long").alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c in docs.columns])
