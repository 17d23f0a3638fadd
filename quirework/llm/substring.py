"""Substring dedup by seed and extend.

Seeds: of every ``window - k + 1`` consecutive word k-grams the one with the least hash is an anchor. Two equal windows
have their anchor at the same place, so a window can only repeat if its anchor does, and anchors that the corpus has
once are done with. Occurrences of an anchor are joined by what they extend to:

* to both sides as far as any window with this anchor reaches (a zone). Occurrences with equal zones repeat whole: all
  but the first go.
* where an anchor has several zones, the first occurrence of each zone is extended to every single window, and windows
  that are equal meet under one key; again all but the first go. That finds the ends of passages.

So a passage in a third of all documents costs a row for each occurrence, never a row for each pair. What is to go is
merged to maximal spans. Keys are 128 bits of hash. Sums are made before shuffles, and joins on anchors, zones or
windows are between written tables, whose hot keys Spark splits. Texts are shuffled, compressed, to the zones and to the
spans of their documents: both grow with the corpus, so neither is broadcast at any size.

Defined results: a null or empty text has no words and keeps the empty text. A window is judged on the input, not on
what is left. Occurrences are ordered by (doc_id, place), a null doc_id first; rows with one id and different texts are
documents of their own, in the order of a hash. Rows alike in both are one document given several times, and no copies
of each other. Texts shorter than a window lose nothing; very long ones are worked on whole, one at a time, in memory of some 100 bytes a word. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, row_key, tidied

WINDOW, K = 20, 6
#: Rows of a batch that are worked on together, and bytes after which results are handed on.
ROWS, BATCH_BYTES = 256, 4 << 20

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of k consecutive words each, by doubling: grams of a and b words make one of a + b."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, size, done = None, 1, 0
    power = mixed(h + np.uint64(salt))
    while done < k:
        if k & size:
            part = power[done : done + n]
            out = part if out is None else mixed(out * ODD + part)
            done += size
        size *= 2
        if size <= k:
            power = mixed(power[: len(power) - size // 2] * ODD + power[size // 2 :])
    return out


def anchor_of_windows(h: np.ndarray, window: int, k: int) -> np.ndarray:
    """The place of each window's anchor: its k-gram with the least hash, the last of equal ones."""
    span = window - k + 1
    if len(h) < window:
        return np.zeros(0, np.int64)
    g = gram_hashes(h, k)
    views = np.lib.stride_tricks.sliding_window_view(g[::-1], span)[::-1]
    return np.arange(len(views)) + span - 1 - views.argmin(1)


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD to the powers 0 to n - 1, and those of its inverse, modulo 2 to the 64."""
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    up, down = np.full(n, ODD), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def zones(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: the first window that has it, how many have it, its hash, and the hash of all words of those windows."""
    place = anchor_of_windows(h, window, k)
    at, a, n = np.unique(place, return_index=True, return_counts=True)
    up, down = powers(1 << max(12, int(len(h)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
    z = mixed((sums[a + n + window - 1] - sums[a]) * down[a] + n.astype(np.uint64) * ODD)
    return a, n, gram_hashes(h, k)[at], z


def pack(a: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """A zone's first window and number of windows (below 256) in one long, in the order of the former."""
    return (a.astype(np.int64) << 8) | n


def find_anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    """row, an (first window and number of windows of the zone), g (anchor), z (zone): docs has row and text."""
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part, found = batch.slice(start, ROWS), []
                for i, text in enumerate(part.column(1)):
                    h = word_hashes((text.as_py() or b"").split())
                    if len(h) >= window:
                        a, n, g, z = zones(h, window, k)
                        found.append((np.full(len(a), i), pack(a, n), g.view(np.int64), z.view(np.int64)))
                if found:
                    i, an, g, z = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(an), pa.array(g), pa.array(z)], names=["row", "an", "g", "z"])

    return docs.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"row {kind}, an long, g long, z long")


def packed(docs: DataFrame) -> DataFrame:
    """row and z, the text compressed, for the shuffle."""
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.compress(t.as_py() or b"") for t in part.column(1)], pa.binary())], names=["row", "z"])

    return docs.select("row", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"row {kind}, z binary")


def extended(joined: DataFrame, window: int, k: int) -> DataFrame:
    """row, an (a single window), g (its anchor), w (its hash) for each window of the zones. joined: row, z, zones."""
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, out, held = batch.column(0), [], 0
            for i, (z, an) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                h = word_hashes(d.decompress(z.as_py()).split())
                place = anchor_of_windows(h, window, k)
                edge = np.zeros(len(place) + 1, np.int64)
                first, n = an.values.to_numpy() >> 8, an.values.to_numpy() & 255
                inside = first + n <= len(place)
                np.add.at(edge, first[inside], 1)
                np.add.at(edge, (first + n)[inside], -1)
                at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                out.append((np.full(len(at), i), pack(at, 1), gram_hashes(h, k)[place[at]].view(np.int64), gram_hashes(h, window, 1)[at].view(np.int64)))
                held += 32 * len(at)
                if held > BATCH_BYTES or i == batch.num_rows - 1:
                    n, an, g, w = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(n)), pa.array(an), pa.array(g), pa.array(w)], names=["row", "an", "g", "w"])
                    out, held = [], 0

    return joined.select("row", "z", "zones").mapInArrow(run, f"row {kind}, an long, g long, w long")


def merged(ranges: DataFrame, window: int) -> DataFrame:
    """row, spans (array of struct start, end): the maximal spans that a row's zones cover. ranges: row, zones."""
    kind = ranges.schema["row"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for zones in batch.column(1):
                an = np.sort(zones.values.to_numpy())
                start, end = an >> 8, np.maximum.accumulate((an >> 8) + (an & 255) + window - 1)
                new = np.concatenate(([True], start[1:] > end[:-1]))
                last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(an) - 1]))
                out.append([{"start": a, "end": b} for a, b in zip(start[new].tolist(), end[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, spans)], names=["row", "spans"])

    return ranges.select("row", "zones").mapInArrow(run, f"row {kind}, spans array<struct<start:int,end:int>>")


def without(joined: DataFrame, digest: bool) -> DataFrame:
    """row, n_words, n_removed, spans, and kept_sha256 or kept, the words outside the spans joined by one space. joined: row, z, spans (null: none)."""
    kind = joined.schema["row"].dataType.simpleString()
    last = "kept_sha256" if digest else "kept"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                n, gone, kept_spans, texts = [], [], [], []
                for z, spans in zip(part.column(1), part.column(2), strict=True):
                    words = d.decompress(z.as_py()).split()
                    own = [s for s in spans.as_py() or [] if s["end"] <= len(words)]
                    kept, at = [], 0
                    for s in own:
                        kept += words[at : s["start"]]
                        at = s["end"]
                    text = b" ".join(kept + words[at:])
                    n.append(len(words))
                    gone.append(sum(s["end"] - s["start"] for s in own))
                    kept_spans.append(own)
                    texts.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept_spans, spans_type), pa.array(texts, pa.string())], names=["row", "n_words", "n_removed", "spans", last])

    return joined.select("row", "z", "spans").mapInArrow(run, f"row {kind}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, {last} string")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """row, spans: what is to go from each document that repeats anything. docs: row, text."""
    anchors = find_anchors(docs, window, k)
    counts = anchors.groupBy("g").agg(F.count("*").alias("n"), (F.min("z") < F.max("z")).alias("contested"))
    repeated = materialised(counts.filter("n > 1").drop("n"), "anchors")
    seeds = materialised(anchors.join(repeated, "g"), "seeds")
    firsts = materialised(seeds.groupBy("g", "z").agg(F.min(F.struct("row", "an")).alias("first"), F.count("*").alias("n"), F.max("contested").alias("contested")), "zones")
    own = F.struct("row", "an")
    gone = seeds.join(firsts.filter("n > 1").select("g", "z", "first"), ["g", "z"]).filter(own > F.col("first")).select("row", "an")

    tried = materialised(firsts.filter("contested").select("first.*").groupBy("row").agg(F.collect_list("an").alias("zones")), "tried")
    windows = materialised(extended(packed(docs).join(tried.hint("merge"), "row"), window, k), "windows")
    heads = materialised(windows.groupBy("g", "w").agg(F.min(own).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "heads")
    ends = windows.join(heads, ["g", "w"]).filter(own > F.col("first")).select("row", "an")
    return merged(gone.union(ends).groupBy("row").agg(F.collect_list("an").alias("zones")), window)


@tidied
def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = K, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans, and kept (or with digest kept_sha256): a row for each row of docs (doc_id, text)."""
    own = docs.select(row_key().alias("row"), "text")
    spans = materialised(repeated_spans(own, window, k), "spans")
    out = without(packed(own).join(spans.hint("merge"), "row", "left"), digest)
    return out.select(F.col("row.id").alias("doc_id"), *[c for c in out.columns if c != "row"])
