"""Null and shared ids, repeated rows, empty tables, clashing columns, very long texts: each operator's defined results."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quirework.llm import bpe, chat, decontaminate, extract, line_dedup, minhash, quality, substring, url_filter, warc
from quirework.llm.queries import RULES, VOCABULARY

#: Names that operators use for columns of their own.
CLASH = ("row", "line", "at", "key", "node", "n", "h1", "h2", "label", "z", "an", "g", "w", "m", "s", "seeds", "spans", "_row", "_doc", "_text", "n_words", "kept", "bands", "first", "host", "bad", "segments", "payload", "item_id", "turns")
LINE = "A line of twenty-four characters and more stands here."


def docs_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_lines_of_null_and_shared_ids(spark):
    """A null id comes first; rows with one id and other texts are documents of their own, equal rows are no repeats of each other."""
    other = LINE.replace("line", "lane of another kind")
    docs = docs_of(spark, [(2, LINE), (None, LINE), (None, other), (2, LINE + "\n" + LINE[:-1]), (None, None), (3, "x " + LINE), (3, "x " + LINE)])
    got = sorted_rows(line_dedup.dedup_report(docs), "doc_id", "n_lines", "n_exact", "n_near", "removed")
    want = [(None, 1, 0, 0, []), (None, 1, 0, 0, []), (None, 1, 0, 0, []), (2, 1, 1, 0, [0]), (2, 2, 1, 1, [0, 1]), (3, 1, 0, 0, []), (3, 1, 0, 0, [])]
    assert got == sorted(want, key=repr)
    kept = line_dedup.without_repeats(docs)
    assert sorted_rows(kept, "doc_id", "text") == sorted([(None, LINE), (None, other), (None, None), (3, "x " + LINE), (3, "x " + LINE)], key=repr)
    assert line_dedup.without_repeats(docs).columns == docs.columns


def test_minhash_of_null_and_shared_ids(spark):
    a, b = words("a", 30), words("b", 30)
    docs = docs_of(spark, [(None, a), (None, a), (5, a), (5, b), (6, b), (7, words("c", 30)), (None, None), (8, "")])
    got = sorted_rows(minhash.near_duplicates(docs.select("doc_id", "text", "node", "n")), "doc_id", "n_shingles", "component_id", "kept")
    want = [(None, 26, 5, False), (None, 26, 5, False), (5, 26, 5, True), (5, 26, 5, True), (6, 26, 5, False), (7, 26, 7, True), (None, 0, None, True), (8, 0, 8, True)]
    assert got == sorted(want, key=repr)


def test_decontamination_of_null_and_shared_ids(spark):
    """Rows alike in id and text are one document; repeated items count once, items that share an id are one."""
    leak, short = words("l", 12), "two words"
    docs = docs_of(spark, [(1, "x " + leak), (1, short), (None, leak), (None, "none"), (2, "clean"), (2, "clean"), (3, None), (4, leak + " " + short)])
    bench = spark.createDataFrame([(9, leak), (9, leak), (9, short), (None, short), (10, None), (11, "")], "item_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c != "item_id"])
    got = sorted_rows(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "items", "contaminated")
    want = [(1, 13, 12, ["9"], True), (1, 2, 2, ["9"], True), (None, 12, 12, ["9"], True), (None, 1, 0, [], False), (2, 1, 0, [], False), (3, 0, 0, [], False), (4, 14, 14, ["9"], True)]
    assert got == sorted(want, key=repr)


def test_small_bit_tables(spark, monkeypatch):
    """A table far too small for the seeds lets more pass to the join, and changes nothing."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(n))
    items = [text(40) for _ in range(60)]
    docs = docs_of(spark, [(i, text(50) + (" " + items[i % 60][:60] if i % 3 == 0 else "")) for i in range(90)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = sorted_rows(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "items")
    monkeypatch.setattr(decontaminate.find_hits, "__defaults__", (*decontaminate.find_hits.__defaults__[:2], 64))
    assert sorted_rows(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "items") == whole and any(r[2] for r in whole)


def test_substrings_of_null_and_shared_ids(spark):
    a = words("a", 25)
    docs = docs_of(spark, [(2, a), (2, a), (None, "y " + a), (None, words("b", 30)), (3, a + " end"), (4, None), (None, "")])
    got = sorted_rows(substring.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept")
    want = [(2, 25, 25, ""), (2, 25, 25, ""), (None, 26, 0, "y " + a), (None, 30, 0, words("b", 30)), (3, 26, 25, "end"), (4, 0, 0, ""), (None, 0, 0, "")]
    assert got == sorted(want, key=repr)


def test_quality_and_bpe_of_any_columns(spark):
    docs = docs_of(spark, [(None, None), (1, ""), (1, " \n\t "), (2, words("w", 12) + "."), (2, words("w", 12) + ".")])
    got = sorted_rows(quality.measured(docs), "doc_id", "n_words", "base_failed", "kept")
    assert got == sorted([(None, 0, True, False), (1, 0, True, False), (1, 0, True, False), (2, 12, False, True), (2, 12, False, True)], key=repr)
    assert quality.clean_documents(docs).columns == docs.columns and quality.clean_documents(docs).count() == 2
    none = hashlib.sha256(b"").hexdigest()
    rows = sorted_rows(bpe.digests(docs, VOCABULARY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert (None, 0, none, none) in rows and (1, 0, none, none) in rows and len(rows) == 5


def test_chats_of_any_columns(spark):
    chats = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 0, "user", "q"), (None, None, None, None)], "conv_id long, turn long, role string, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    got = sorted_rows(chat.chat_digests(chat.format_chats(chats)), "conv_id", "n_turns", "loss_chars", "valid")
    assert got == sorted([(1, 3, 0, False), (None, 1, 0, False)], key=repr)
    assert chat.chat_digests(chat.format_chats(chats.limit(0))).count() == 0


def test_long_chat(spark):
    """One conversation of 20,000 turns and one turn of a million control characters."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("</s> x \\").alias("text"))
    big = spark.range(2).select(F.lit(2).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("\\</s>"), F.lit(200_000)).alias("text"))
    got = sorted_rows(chat.chat_digests(chat.format_chats(rows.union(big))), "conv_id", "n_turns", "loss_chars", "valid")
    assert got == [(1, 20_000, 80_000, True), (2, 2, 1_000_000, True)]


def test_archives_of_any_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, None, None)], "page_id long, url string, html string").select("*", *[F.lit(i).alias(c) for i, c in enumerate((*CLASH, "content", "path", "head"))])
    records = warc.convert_arcs(warc.pages_to_arcs(pages)).withColumns({"refers_to": F.lit(None).cast("long"), "refers_to_id": F.lit(None).cast("string")})
    warc.write_warcs(records, F.lit(None).cast("long"), str(tmp_path / "w"))
    assert sorted_rows(warc.read_warcs(spark, str(tmp_path / "w")), "page_id", "payload_bytes", "intact") == [(None, 0, True), (None, 1, True), (None, 1, True)]
    warc.write_warcs(records.limit(0), F.lit(1), str(tmp_path / "none"))
    assert warc.read_warcs(spark, str(tmp_path / "none")).count() == 0


def test_very_long_texts(spark):
    """A text of a million words and one of a single word of a million characters, through every operator on documents."""
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(300_000))
    docs = docs_of(spark, [(0, long), (1, "x" * 1_000_000), (2, "lead " + long)])
    began = time.time()
    assert sorted_rows(line_dedup.dedup_report(docs), "doc_id", "n_exact", "n_near") == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert sorted_rows(minhash.near_duplicates(docs.select("doc_id", "text")), "doc_id", "component_id") == [(0, 0), (1, 1), (2, 0)]
    assert sorted_rows(substring.dedup_substrings(docs, digest=True), "doc_id", "n_removed") == [(0, 0), (1, 0), (2, 300_000)]
    bench = spark.createDataFrame([(0, " ".join(long.split()[1000:1020]))], "item_id long, text string")
    assert sorted_rows(decontaminate.contamination(docs, bench), "doc_id", "n_hit") == [(0, 20), (1, 0), (2, 20)]
    assert sorted_rows(quality.measured(docs), "doc_id", "n_words", "n_repeat_words") == [(0, 300_000, 0), (1, 1, 0), (2, 300_001, 0)]
    assert bpe.digests(docs, VOCABULARY).filter("n_tokens > 0").count() == 3
    assert time.time() - began < 240


@pytest.mark.parametrize("name", ["lines", "minhash", "substrings", "decontamination", "quality", "bpe", "urls", "pages", "chats"])
def test_empty_tables(spark, name):
    none = docs_of(spark, []).limit(0)
    pages, bench = spark.createDataFrame([], "page_id long, url string, html string"), spark.createDataFrame([], "item_id long, text string")
    out = {
        "lines": lambda: line_dedup.dedup_report(none), "minhash": lambda: minhash.near_duplicates(none), "substrings": lambda: substring.dedup_substrings(none), "decontamination": lambda: decontaminate.contamination(none, bench),
        "quality": lambda: quality.clean_documents(none), "bpe": lambda: bpe.digests(none, VOCABULARY), "urls": lambda: url_filter.filter_urls(pages, spark.createDataFrame([], "doc_id long, quality int"), RULES), "pages": lambda: extract.extract(pages),
        "chats": lambda: chat.chat_digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    }[name]()
    assert out.count() == 0


def test_pipeline_of_any_rows(spark, tmp_path):
    """Nulls, an empty table, clashing columns and a repeated row through all stages."""
    import corpus_pipeline

    text = "\n".join(" ".join(f"{c}{i}x{j}" for j in range(12)) + "." for i, c in enumerate("abcde"))
    spark.createDataFrame([(1, words("q", 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_of(spark, [(1, text), (1, text), (None, None), (2, ""), (None, words("n", 15) + "."), (3, words("q", 15) + ".")]).write.parquet(str(tmp_path / "documents.parquet"))
    left = docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.written(stage, name, spark, left, str(tmp_path))
        assert left.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted_rows(last(spark, left, str(tmp_path)), "doc_id") == sorted([(1,), (None,)], key=repr) and last(spark, docs.limit(0), str(tmp_path)).count() == 0
