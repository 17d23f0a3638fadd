"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct word shingles. Two fixed permutations of the 32-bit integers make its whole
signature: the first scatters the shingles, and coordinate number i is the least value of the second one shifted
circularly by i. Bands of coordinates name buckets; a pair that meets in a bucket is confirmed on the full sets, by
exact integer arithmetic; links join to components.

Documents with equal sets, told by 128 bits of hash, are one node from the start. Buckets of any size don't become pairs.
Shingles that no other candidate has can't be in an intersection: with their number, a bound on each pair's similarity
rules most pairs out, exactly. In each bucket the rest is first tried with one chosen member, over a few rounds with
other choices, and only between nodes that aren't yet connected; where copies share an original, that joins them. The
nodes of buckets that are still open then meet by their rarest shingles: of two linked sets, each has one of those
shingles among as many as it may lack of the other, and one more. Pairs that share such a shingle, differ in label and
aren't of too different size are confirmed; where very many nodes share one, they are dealt into blocks of bounded
number and bytes, every two blocks are one group, and a group counts all its intersections by matrix products and
returns only the links that join components. So no link between nodes that meet in a bucket is lost to a choice, no
group grows with the data, and work that is quadratic is left only to rare shingles that a crowd shares after all.

A pair of similarity 0.8 misses all 32 bands of 4 with a probability of 5e-8, if coordinates are independent; a test
compares the misses of the circulant ones with that formula where they are frequent enough to count.

Defined results: a text without words (null, empty) is linked with nothing. With fewer words than a shingle the whole
sequence is the one shingle. A text of any length is one set, worked on in blocks of shingles. Repeated rows are equal
sets, each with a row of its own. Null ids are linked like others but lose to any number as the component's id. An empty
table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, tidied
from .graph import components
from .substring import ROWS, gram_hashes, packed, word_hashes

BANDS, PER_BAND = 32, 4
COORDINATES = BANDS * PER_BAND
#: Shingles worked on at a time.
BLOCK = 1024
#: Rounds of trying pairs with one member of a bucket.
ROUNDS = 2
#: Nodes that share a rare shingle from which they are compared in blocks; nodes and compressed bytes of a block; shingles of a matrix product.
PAIRED, BLOCK_NODES, BLOCK_BYTES, COLUMNS = 64, 512, 4 << 20, 4096


def scattered(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers; x is overwritten."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of k words, A-Z lower-cased."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return h
    return np.unique(gram_hashes(h, min(k, len(h)), salt=7 if len(h) < k else 0))


def signature(s: np.ndarray) -> np.ndarray:
    """COORDINATES values of 32 bits for a non-empty set."""
    x = scattered((s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(COORDINATES, dtype=np.uint32)
    out = np.full(COORDINATES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), BLOCK):
        shifted = x[at : at + BLOCK, None] + shifts[None, :]
        np.minimum(out, scattered(shifted, 0x85EBCA6B, 0xC2B2AE35).min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, PER_BAND)
    return np.array([xxhash.xxh3_64_intdigest(rows[i].tobytes(), seed=i) for i in range(BANDS)], np.uint64).view(np.int64)


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of hash of a set, as two signed longs."""
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (shingles), h1, h2 (hash of the set; null if empty), bands (array of long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                n, sets, bands = [], [], []
                for text in part.column(1):
                    s = shingles(text.as_py() or b"", k)
                    n.append(len(s))
                    sets.append(identity(s) if len(s) else (None, None))
                    bands.append(band_keys(signature(s)) if len(s) else None)
                h1, h2 = (pa.array(h, pa.int64()) for h in zip(*sets, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), h1, h2, pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "h1", "h2", "bands"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n long, h1 long, h2 long, bands array<long>")


def packed_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """node, n, z (its text, compressed) for the wanted nodes (doc_id, node, n, h1, h2: one document of each node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            # Of rows that share a doc_id, only those with the node's own set count.
            found = [identity(shingles(d.decompress(z.as_py()), k)) for z in batch.column("z")]
            own = zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)
            keep = pa.array([i for i, h in enumerate(own) if h == found[i]], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("node", "n", "z")], names=["node", "n", "z"])

    source = packed(docs.select(F.struct("doc_id").alias("row"), "text"))
    want = wanted.select(F.struct("doc_id").alias("row"), "node", "n", "h1", "h2")
    # The wanted grow with the corpus: sorted and merged at every size, never broadcast.
    found = source.join(want.hint("merge"), "row").select("node", "n", "h1", "h2", "z").mapInArrow(run, "node long, n long, z binary")
    return found.groupBy("node").agg(F.first("n").alias("n"), F.first("z").alias("z"))


def confirmed(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, last, left = zstandard.ZstdDecompressor(), None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (za, zb) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                if a[i] != last:
                    last, left = a[i], shingles(d.decompress(za.as_py()), k)
                right = shingles(d.decompress(zb.as_py()), k)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    good.append(i)
            keep = pa.array(good, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    left, right = (sets.select(F.col("node").alias(c), F.col("z").alias(f"z{c}")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "za", "zb")
    return both.mapInArrow(run, "a long, b long")


def shingle_rows(sets: DataFrame, k: int) -> DataFrame:
    """node, g: a row for each shingle of each set. sets: node, z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [shingles(d.decompress(z.as_py()), k) for z in part.column(1)]
                nodes = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(s) for s in found])))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(np.concatenate(found).view(np.int64))], names=["node", "g"])

    return sets.select("node", "z").mapInArrow(run, "node long, g long")


def shared_counts(sets: DataFrame, k: int) -> DataFrame:
    """node, n (its shingles), c (those that another node has too). sets: node, n, z."""
    seen = shingle_rows(sets, k).groupBy("g").agg(F.min("node").alias("node"), F.count("*").alias("holders"))
    alone = seen.filter("holders = 1").groupBy("node").agg(F.count("*").alias("alone"))
    return sets.select("node", "n").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))


def rare_shingles(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """node, g, at: the shingles of which two linked sets share one at least, and how many of the set's own come before it. sets: node, n, z.

    A set of n shingles may lack n - ceil(percent * n / 100) in a linked one, so one more of its shingles, in one order
    for all sets, are enough; those that few sets have come first, and those that no other has need no row.
    """
    rows = materialised(shingle_rows(sets, k), "shingles")
    holders = rows.groupBy("g").agg(F.count("*").alias("holders")).filter("holders > 1")
    ranked = rows.join(holders, "g").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "g"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    room = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone).cast("int")
    first = F.when(room > 0, F.slice("shared", F.lit(1), F.greatest(room, F.lit(1)))).otherwise(F.array().cast("array<struct<holders:bigint,g:bigint>>"))
    return sets.select("node", "n").join(ranked, "node").select("node", alone.alias("alone"), F.posexplode(first).alias("i", "x")).select("node", F.col("x.g").alias("g"), (F.col("alone") + F.col("i")).alias("at"))


def links_of_block(found: list[np.ndarray], first: np.ndarray, second: np.ndarray, labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Index pairs, one from first and one from second, that are linked and join different labels; none that earlier ones make needless."""
    sizes = np.array([len(s) for s in found], np.int64)
    g, column = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(np.arange(len(found)), sizes)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(first), len(second)), np.float32)
    place = {s: np.full(len(found), -1) for s in "ab"}
    place["a"][first], place["b"][second] = np.arange(len(first)), np.arange(len(second))
    for start in range(0, len(g), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        dense = []
        for s, members in (("a", first), ("b", second)):
            m = np.zeros((len(members), COLUMNS), np.float32)
            at = place[s][owner[lo:hi]]
            m[at[at >= 0], column[lo:hi][at >= 0] - start] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    linked = 100 * both >= percent * (sizes[first][:, None] + sizes[second][None, :] - both)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = find(labels[first[i]]), find(labels[second[j]])
        if a != b:
            root[a] = b
            out.append((int(first[i]), int(second[j])))
    return out


def links_by_blocks(members: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between nodes of one group with different labels, enough of them to join all labels that are linked. members: node, label, key (the group). sets: node, z."""
    own = members.join(sets.select("node", F.octet_length("z").alias("bytes")), "node")
    sizes = own.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = own.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A node goes to one group with each block of its crowd.
    met = dealt.select("key", "node", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(sets.select("node", "z"), "node")
    grouped = met.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label", "z").groupBy("key", "x", "y")

    def run(table: pa.Table) -> pa.Table:
        d = zstandard.ZstdDecompressor()
        own, node, label = (table.column(c).to_pylist() for c in ("own", "node", "label"))
        found = [shingles(d.decompress(z.as_py()), k) for z in table.column("z")]
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        sides = [np.array([i for i, o in enumerate(own) if o == s], np.int64) for s in (x, y)]
        pairs = links_of_block(found, *sides, label, percent) if all(map(len, sides)) else []
        return pa.table({"a": pa.array([node[i] for i, _ in pairs], pa.int64()), "b": pa.array([node[j] for _, j in pairs], pa.int64())})

    return grouped.applyInArrow(run, "a long, b long")


def links_by_rare_shingles(rest: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between nodes of rest (node, label) with different labels, enough of them to join all labels that are linked."""
    own = materialised(sets.join(rest, "node"), "rest_sets")
    rows = materialised(rare_shingles(own, k, percent).join(own.select("node", "label", "n"), "node"), "rare")
    # Shingles that the same nodes share are one group, and those of one label none.
    groups = rows.groupBy("g").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("too"))
    groups = materialised(groups.filter("low < high").groupBy("size", "who", "too").agg(F.min("g").alias("g")).select("g", "size"), "groups")
    few = rows.join(groups.filter(F.col("size") <= PAIRED).select("g"), "g")
    a, b = (few.select("g", F.col("node").alias(c), F.col("label").alias(f"label_{c}"), F.col("n").alias(f"n_{c}"), (F.col("n") - F.col("at")).alias(f"left_{c}")) for c in "ab")
    # Of the shingles that two sets share one comes first, and all the others stand behind it in both.
    fits = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & ((100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b")))
    pairs = materialised(a.join(b, "g").filter(fits).select("a", "b").distinct(), "rare_pairs")
    many = rows.join(groups.filter(F.col("size") > PAIRED).select("g"), "g").select("node", "label", F.col("g").alias("key"))
    return confirmed(pairs, own, k, percent).union(links_by_blocks(many, own, k, percent))


@tidied
def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach), kept: a row for each row of docs (doc_id, text)."""
    seen = materialised(signed(docs, k), "signatures")
    equal = seen.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialised(equal.withColumn("node", F.monotonically_increasing_id()), "nodes")
    dealt = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialised(dealt.groupBy("key").count().filter("count > 1").select("key"), "buckets")
    met = materialised(dealt.join(shared, "key"), "met")
    involved = nodes.join(met.select("node").distinct(), "node", "left_semi").select("doc_id", "node", "n", "h1", "h2")
    sets = materialised(packed_sets(docs, k, involved), "sets")
    # A node of which too little is shared with any other is linked with none.
    able = materialised(shared_counts(sets, k).filter(100 * F.col("c") >= percent * F.col("n")), "able")
    members = materialised(met.join(able, "node"), "members")

    def fits(n: str, c: str, m: str, e: str):
        """No intersection is larger than what both share with others."""
        return (100 + percent) * F.least(c, e) >= percent * (F.col(n) + F.col(m))

    labels = able.select("node", F.col("node").alias("label"))
    for turn in range(ROUNDS + 1):
        at = materialised(members.join(labels, "node"), "labelled")
        # Buckets whose members are all connected have nothing left to find.
        rank = F.col("node") if turn == 0 else F.xxhash64("node", "key", F.lit(turn))
        heads = at.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "node", "n", "c", "label")).alias("head"), (F.min("label") < F.max("label")).alias("open")).filter("open").drop("open")
        open_ = at.join(materialised(heads, "heads"), "key")
        if turn < ROUNDS:
            pairs = open_.filter((F.col("label") != F.col("head.label")) & fits("n", "c", "head.n", "head.c")).select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
            links = confirmed(materialised(pairs.distinct(), "pairs"), sets, k, percent)
        else:
            rest = materialised(open_.select("node", "label").distinct(), "rest")
            links = links_by_rare_shingles(rest, sets, k, percent)
        # Links between labels join components of earlier rounds.
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = links.join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        roots = materialised(components(edges), "roots")
        labels = materialised(labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")

    # Only nodes with a link or with several rows have another document to point to.
    ids = nodes.select("node", "doc_id", "rows", "h1", "h2").join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("label"), "doc_id", "rows")
    least = materialised(ids.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.sum("rows").alias("rows")).filter("rows > 1").drop("rows"), "components")
    of_set = materialised(ids.join(least, "label").select("h1", "h2", "component_id"), "classes")
    out = seen.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(of_set, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
