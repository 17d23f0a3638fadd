"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over the last bytes decides whether a text is cut, at any character of any script, so equal passages fall
into equal chunks wherever they stand. A chunk that documents share is encoded once by each worker process: its ids stay
in a least-recently-used table with a fixed bound in bytes. A cut may fall inside a word, and then the ids on both sides
of it are wrong. So every join is encoded again, between the nearest places to the left and right that are word
boundaries whatever stands around them: in front of white space behind something else, and behind a letter in front of
something that is none. If a side has no such place, the next chunk is taken in, up to the whole text. Where the new ids
differ from the chunks' own, they replace them.

Special tokens are split off first. Runs of white space beyond LONG_RUN characters are taken apart by the rule of the
pattern (all but the last character is one word in front of something else), as the pattern engine can't match them.

Decoding turns ids into bytes and those into text, invalid UTF-8 into U+FFFD. Ids are those of the ``tokenizers`` library
for the vocabulary file, special tokens in the text included. Encoding itself runs in ``tiktoken`` on the same vocabulary
and pattern, which is several times faster; tests hold the two together. Nothing is shuffled; the memory is one batch of
rows, one text and the table.

Defined results: a null or empty text has no ids. A text of any length and any content is encoded whole. Repeated rows
are encoded row by row. An empty table gives no rows. Further columns stay out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how a byte-level vocabulary splits text before merging (the public pattern of 2019).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes that the rolling hash looks at, and a cut in how many characters.
WINDOW, ONE_IN = 8, 1024
#: Characters of white space from which a run is taken apart before the pattern sees it.
LONG_RUN = 10_000
#: Fixed value: Unicode's white space.
WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG = re.compile(f"(?<!{WHITE}){WHITE}{{{LONG_RUN},}}")
#: Bytes on either side of a join that are searched for a word boundary first.
AROUND = 64
#: Bytes of chunks and ids that a worker process keeps.
KEPT_BYTES = 48 << 20


def byte_of_symbol() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: itself if it is printable Latin-1, else the next free code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkedBpe:
    """Encoder and decoder of one vocabulary file, with its table of chunks."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbol = byte_of_symbol()
        ranks = {bytes(symbol[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = {x.encode(): i for x, i in special.items()}
        self.any_special = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")")
        self.size_of = np.zeros(1 + max([*ranks.values(), *special.values()]), np.int64)
        for token, i in ranks.items():
            self.size_of[i] = len(token)
        self.table: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.room = kept_bytes
        self.hits = self.misses = self.joins = self.repairs = 0
        rng = np.random.default_rng(20240501)
        self.mix = rng.integers(0, 1 << 32, (WINDOW, 256), dtype=np.uint32)

    def cuts(self, data: bytes) -> list[int]:
        """Where chunks start, 0 left out: at characters where the hash of the WINDOW bytes before says so."""
        b = np.frombuffer(data, np.uint8)
        if len(b) <= 2 * WINDOW:
            return []
        h = np.zeros(len(b) - WINDOW, np.uint32)
        for k in range(WINDOW):
            h += self.mix[k][b[WINDOW - 1 - k : len(b) - 1 - k]]
        at = np.flatnonzero((h >> np.uint32(7)) % ONE_IN == 0) + WINDOW
        return at[(b[at] & 0xC0) != 0x80].tolist()

    def plain(self, data: bytes) -> np.ndarray:
        """The ids of a text in one piece."""
        text = data.decode("utf-8", "replace")
        runs = [m.span() for m in LONG.finditer(text)] if len(text) >= LONG_RUN else []
        if not runs:
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        out, at = [], 0
        for start, end in runs:
            end -= end < len(text)
            out += [self.encoding.encode_to_numpy(text[at:start], disallowed_special=()), np.array(self.encoding._encode_single_piece(text[start:end]), np.uint32)]
            at = end
        out.append(self.encoding.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(out).astype("<u4", copy=False)

    def chunk(self, data: bytes) -> np.ndarray:
        if (ids := self.table.get(data)) is not None:
            self.hits += 1
            self.table.move_to_end(data)
            return ids
        self.misses += 1
        ids = self.plain(data)
        self.table[data] = ids
        self.room -= len(data) + 4 * len(ids) + 200
        while self.room < 0:
            old, gone = self.table.popitem(last=False)
            self.room += len(old) + 4 * len(gone) + 200
        return ids

    def boundary(self, data: bytes, low: int, high: int, last: bool) -> int | None:
        """The first or last place between two characters from low to high (in bytes) that is a word boundary whatever stands around them."""
        size = AROUND
        while True:
            a, b = (max(low, high - size), high) if last else (low, min(high, low + size))
            while low < a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while a < b < high and data[b] & 0xC0 == 0x80:
                b -= 1
            text = data[a:b].decode()
            for i in range(len(text) - 1, 0, -1) if last else range(1, len(text)):
                x, y = text[i - 1], text[i]
                if (y in " \n" and not x.isspace()) or (x.isalpha() and not y.isalpha() and category(y) != "Cn"):
                    return a + len(text[:i].encode())
            if b - a == high - low:
                return None
            size *= 4

    def tokens_in(self, ids: np.ndarray, size: int) -> int:
        """How many of the ids make the first size bytes, which end with a word."""
        return int(np.searchsorted(np.cumsum(self.size_of[ids]), size, "right")) if size else 0

    def ordinary(self, data: bytes) -> np.ndarray:
        """The ids of a text without special tokens: those of its chunks, encoded again around each join."""
        edges = [0, *self.cuts(data), len(data)]
        ids = self.chunk(data[: edges[1]])
        out, at, i = [], 0, 1  # what is right, the word start that it reaches, and the next chunk
        while i < len(edges) - 1:
            start = self.boundary(data, at, edges[i], True)
            kept = self.tokens_in(ids, start - at) if start is not None else 0
            out.append(ids[:kept])
            start = at if start is None else start
            own, end = [ids[kept:]], None
            while end is None and i < len(edges) - 1:
                ids = self.chunk(data[edges[i] : edges[i + 1]])
                end = self.boundary(data, edges[i], edges[i + 1], False)
                gone = len(ids) if end is None else self.tokens_in(ids, end - edges[i])
                own.append(ids[:gone])
                ids = ids[gone:]
                i += 1
            at = len(data) if end is None else end
            again = self.plain(data[start:at])
            self.joins += 1
            self.repairs += not np.array_equal(again, np.concatenate(own))
            out.append(again)
        return np.concatenate([*out, ids]) if out else ids

    def encode(self, data: bytes) -> np.ndarray:
        """The ids of a text given in UTF-8, as little-endian unsigned 32-bit integers."""
        if not data:
            return np.zeros(0, "<u4")
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode()
        if not self.special or not self.any_special.search(data):
            return self.ordinary(data)
        pieces = self.any_special.split(data)
        return np.concatenate([np.array([self.special[x]], "<u4") if i % 2 else self.ordinary(x) for i, x in enumerate(pieces) if x])

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@lru_cache(2)
def coder(path: str) -> ChunkedBpe:
    """A worker process loads a vocabulary once."""
    return ChunkedBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int): a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [c.encode(t.as_py() or b"").astype("<i4") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    source = docs.select(id_col, F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, text: a row for each row of coded (id_col, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            texts = [c.decode(np.asarray(x.as_py() or [], dtype="<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return coded.select(id_col, "ids").mapInArrow(run, f"{id_col} {coded.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without sending ids between processes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            n, coded, decoded = [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py() or b"")
                n.append(len(ids))
                coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(id_col, F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
