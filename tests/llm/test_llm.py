"""Each operator against brute force on small rows with nulls, empty and repeated rows, ties and clashing columns."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import bpe, chat, decontaminate, line_dedup, minhash, quality, substring, url_filter, warc
from quirework.llm.queries import RULES, VOCABULARY

DOCS = "doc_id long, text string, n long, row string, key long"


def docs_of(spark, texts):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "r", 2) for i, t in enumerate(texts)], DOCS)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rng.randint(5, 30))) + "."
    lines = [line() for _ in range(80)]
    out = ["\n".join(rng.choice(lines) if rng.random() < 0.5 else line() for _ in range(rng.randint(1, 6))) for _ in range(n)]
    for i in range(0, n, 4):
        t = list(out[i])
        t.insert(rng.randrange(len(t)), "x")
        out.append("".join(t))
    return [*out, out[0], None, "", " \n\t", "one two", "longword" * 500, " ".join(["same"] * 300)]


def edits1(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(texts, within, least=24):
    """doc_id to (exact, near, removed) by comparing every two lines."""
    lines = {(i, k): x.strip(" \t\x0b\x0c\r") for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))}
    first = {}
    for at, x in sorted(lines.items()):
        if len(x) >= least:
            first.setdefault(x, at)
    near = {x for x in first for y in first if first[y] < first[x] and within(x, y)}
    out = {}
    for i in range(len(texts)):
        own = [(k, x) for (d, k), x in lines.items() if d == i and len(x) >= least]
        exact, close = [k for k, x in own if first[x] != (i, k)], [k for k, x in own if first[x] == (i, k) and x in near]
        out[i] = (len(exact), len(close), sorted(exact + close))
    return out, near


def line_report(docs, **options):
    return {r["doc_id"]: (r["n_exact"], r["n_near"], list(r["removed"])) for r in line_dedup.dedup_report(docs, **options).collect()}


@pytest.mark.parametrize("crowd", [40, 1])
def test_line_dedup(spark, crowd):
    """crowd=1 segments every bucket again, 40 hardly any."""
    texts = corpus()
    want, near = brute_lines(texts, edits1)
    assert near and line_report(docs_of(spark, texts), crowd=crowd) == want
    kept = line_dedup.without_repeats(docs_of(spark, texts), crowd=crowd)
    assert kept.columns == [c.split(" ")[0] for c in DOCS.split(", ")] and kept.filter("doc_id = 0").first()["text"] == texts[0]


@pytest.mark.parametrize("edits, crowd", [(1, 40), (2, 1), (2, 5)])
def test_line_dedup_crowds(spark, edits, crowd):
    """Variants of a line by random edits, their original left out, beside a crowd that shares its first half; the lengths vary with the edits."""
    rng = random.Random(edits * 100 + crowd)
    base = "abcdefghijklmnopqrstuvwx"
    texts = ["abcdefghijklmnopXqrstuvwx", "abcdefghijklmnopqrstYuvwx"] + [base[:12] + "".join(rng.choice("0123456789") for _ in range(12)) for _ in range(45)]
    for _ in range(90):
        t = list(base * rng.choice((1, 1, 2)))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(t))
            rng.choice((lambda: t.insert(at, rng.choice("xyz")), lambda: t.__setitem__(at, rng.choice("xyz")), lambda: t.pop(at)))()  # noqa: B023
        texts.append("".join(t))
    want, near = brute_lines(texts, lambda a, b: abs(len(a) - len(b)) <= edits and distance(a, b) <= edits, 20)
    assert near and line_report(docs_of(spark, texts), max_edits=edits, crowd=crowd, least=20) == want
    assert edits > 1 or want[1] == (0, 0, [])


def test_line_dedup_long_lines(spark):
    """Lines of a million characters in a crowd, runs of white space inside."""
    base = "".join(random.Random(5).choice("abcdefgh ") for _ in range(500_000)) + " " * 500_000 + "end"
    texts = [base, base[:-1] + "D", "x" + base, base[:700] + "z" + base[700:], base[:900_000] + "zz" + base[900_002:]]
    assert line_report(docs_of(spark, texts), crowd=1) == {0: (0, 0, []), 1: (0, 1, [0]), 2: (0, 1, [0]), 3: (0, 1, [0]), 4: (0, 0, [])}


@pytest.mark.parametrize("crowd", [1])
def test_line_dedup_two_edits(spark, crowd):
    """Lines of one length that give the same text by losing one character at different places are two edits apart, and stay."""
    half = "abcdefghijklmnop"
    texts = [half + "qrstuvwxyz.1234", half + "qrstuvwxyz.2341", "1234" + half + "qrstuvwxyz.", "2341" + half + "qrstuvwxyz."]
    assert not any(edits1(a, b) for a in texts for b in texts)
    got = {r["doc_id"]: r["n_near"] for r in line_dedup.dedup_report(docs_of(spark, texts), crowd=crowd).collect()}
    assert got == dict.fromkeys(range(4), 0)
    # With the shortened line at the end only that one is near; at the start both are near it.
    short = half + "qrstuvwxyz.234"
    for order, want in (([*texts[:2], short], [0, 0, 1]), ([texts[0], short, texts[1]], [0, 1, 1])):
        got = {r["doc_id"]: r["n_near"] for r in line_dedup.dedup_report(docs_of(spark, order), crowd=crowd).collect()}
        assert got == dict(enumerate(want))


def test_line_dedup_short_lines(spark):
    """With exact_least=1 every line with a word goes if an earlier one equals it; shorter lines than least have no near ones."""
    long = "abcdefghijklmnopqrstuvwxyz"
    texts = ["Les.\nHome\n\n" + long, " Les.\nHomes\n\n" + long + ".", "x\nLes.\n \nHome", long + "\nx", None]
    want = {0: (0, 0, []), 1: (1, 1, [0, 3]), 2: (2, 0, [1, 3]), 3: (2, 0, [0, 1]), 4: (0, 0, [])}
    got = {r["doc_id"]: (r["n_exact"], r["n_near"], list(r["removed"])) for r in line_dedup.dedup_report(docs_of(spark, texts), exact_least=1).collect()}
    assert got == want


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, k):
    sets, root = [shingle_set(t, k) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return sets, root


@pytest.mark.parametrize("rounds, paired", [(2, 64), (0, 64), (0, 2)])
def test_minhash(spark, monkeypatch, rounds, paired):
    """Without rounds all links come from rare shingles, by pairs or by blocks of four nodes."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 4)
    texts = corpus(2, 40)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts += [" ".join(rng.choice("abc") + w if rng.random() < 0.02 else w for w in base) for _ in range(12)]
    sets, root = brute_components(texts, 4)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(spark, texts), k=4).collect()}
    assert len(set(root)) < len(texts)
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root[i], root[i] == i)


def test_circulant_misses():
    """Pairs that share no band are as rare as with independent coordinates, for small and large sets; at 0.8 none is found."""
    rng = np.random.default_rng(5)
    for n, percent, pairs in ((10, 50, 1500), (100, 50, 1500), (1000, 50, 300), (100, 80, 500), (20, 80, 500)):
        both, missed = round(2 * n * percent / (100 + percent)), 0
        for _ in range(pairs):
            x = rng.integers(0, 1 << 63, 2 * n - both, np.uint64)
            one, two = (minhash.band_keys(minhash.signature(s)) for s in (x[:n], x[n - both :]))
            missed += not (one == two).any()
        want = pairs * (1 - (both / (2 * n - both)) ** minhash.PER_BAND) ** minhash.BANDS
        assert abs(missed - want) <= 4 * want**0.5 + 1, (n, percent, missed, want)


def test_substrings(spark):
    texts = corpus(4) + [" ".join(f"v{i}" for i in range(60)), "q " * 7 + " ".join(f"v{i}" for i in range(10, 45)) + " z"]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    rows = substring.dedup_substrings(docs_of(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == want
    assert sum(w[1] for w in want.values()) > 300


def test_decontamination(spark):
    texts = corpus(5)
    words = lambda t: re.findall(decontaminate.WORD, (t or "").translate(str.maketrans(*("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
    items = [" ".join(words(texts[3])[2:16]), "one two", "SAME", None, "", " ".join(words(texts[5])[:10]).upper()]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs_of(spark, texts), bench).collect()}
    windows = [(i, tuple(w[k : k + min(10, len(w))])) for i, t in enumerate(items) for w in [words(t)] if w for k in range(max(1, len(w) - 9))]
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(str(item))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) == (len(w), len(hit), sorted(found), bool(hit))


def test_quality(spark):
    texts = corpus(6) + ["Home | About | News | Contact | Help", "A clean sentence stands here, with words enough for anyone.\nAll rights reserved."]
    rows = {r["doc_id"]: r for r in quality.measured(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        assert (rows[i]["n_words"], rows[i]["n_repeat_words"]) == (len(w), len(cover))
    assert not rows[len(texts) - 2]["kept"] and rows[len(texts) - 1]["kept"] and "rights" not in rows[len(texts) - 1]["cleaned"]
    assert quality.clean_documents(docs_of(spark, texts)).columns == [c.split(" ")[0] for c in DOCS.split(", ")]


def test_bpe(spark):
    from tokenizers import Tokenizer

    texts = corpus(7) + ["a <|endoftext|> b", "é  \n\n x's 漢字 🙂", "plain words " * 400]
    t = Tokenizer.from_file(VOCABULARY)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    coded = bpe.encode(docs_of(spark, texts), VOCABULARY)
    assert {r["doc_id"]: list(r["ids"]) for r in coded.collect()} == want
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded, VOCABULARY).collect()} == {i: x or "" for i, x in enumerate(texts)}
    small = bpe.ChunkedBpe(VOCABULARY, kept_bytes=2000)
    assert small.encode(texts[-1].encode()).tolist() == want[len(texts) - 1] and len(small.table) < 20


def test_bpe_repairs(monkeypatch):
    """Cuts at about every eighth character of any script: words, contractions, runs of white space and special tokens are cut and repaired."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    monkeypatch.setattr(bpe, "ONE_IN", 8)
    coder, rng = bpe.ChunkedBpe(VOCABULARY), random.Random(1)
    letters = ["a", "b", "'", "s", "l", " ", " ", "\n", "\t", "\u3000", "漢", "字", "。", "é", "e\u0301", "1", ".", "!", "<|endoftext|>", "'ll", " the", "ж", "🙂", "\x85", "\u00a0", "x"]
    for k in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        text = text.replace(" ", "") if k % 3 == 0 else "".join(rng.choice("漢字かな。 жня") for _ in range(300)) if k % 3 == 1 else text
        ids = coder.encode(text.encode())
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and coder.decode(ids) == text
    assert coder.repairs > 3000 and coder.hits > 100
    assert coder.encode(b"ok \xff x").tolist() == t.encode("ok \ufffd x", add_special_tokens=False).ids


def test_bpe_long_texts():
    """Runs that the pattern engine can't match, and long texts without a space."""
    from tokenizers import Tokenizer

    t, coder, rng = Tokenizer.from_file(VOCABULARY), bpe.ChunkedBpe(VOCABULARY), random.Random(2)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for text in (" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", " " * 1_200_000 + "x", "!" * 2_000_000, pick(" \n\t", 300_000) + "x", pick("漢字的是不", 48_000), pick("абвгдежз", 48_000), pick("абвгдежз ", 300_000), "a" * 300_000):
        assert coder.encode(text.encode()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "a\\[INST] \\\\</s>", "", None, "<<SYS>> x <</SYS>> [TURN] [SAYS] [/TURN]", "line\n\nline "]
    rows = [(c, k, r, t) for c in range(3) for k, (r, t) in enumerate(zip(["system", "user", "assistant", "tool", None, "user", "assistant"], said[c:] + said[:c], strict=True))]
    rows += [(9, 0, "user", "same"), (9, 0, "user", "same"), (None, None, "assistant", "x")]
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for cc, _, r, t in rows if cc == c]
        learned = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[0]["valid"] is False and got[0]["error_turn"] == 3 and got[9]["error_turn"] == 1


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a b", "<p>é</p>"), (2, None, None), (3, "http://c", "<p>é</p>"), (4, "x", "WARC/1.0\r\n\r\nfake"), (3, "http://c", "<p>é</p>"), (None, "u", "")], "page_id long, url string, html string")
    records = warc.convert_arcs(warc.pages_to_arcs(pages, per_file=2)).withColumn("page_id", F.regexp_extract(F.decode("head", "UTF-8"), r"X-Page-Id: (-?\d+)", 1).try_cast("long")).cache()
    path = str(tmp_path / "w")
    warc.write_warcs(warc.with_revisits(records, "page_id", warc.repeated_payloads(records, "page_id")), F.col("page_id"), path)
    back = sorted((r["page_id"] or 0, r["warc_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_warcs(spark, path).collect() if r["intact"])
    assert back == [(0, "revisit", 0, 2), (1, "revisit", 9, 3), (2, "response", 0, None), (3, "response", 9, None), (3, "response", 9, None), (4, "response", 16, None)]
    cut = warc.arc_file("n", "1", [("http://x", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\nbody")])[:-3]
    assert [(c, t) for _, c, t in warc.arc_records(warc.inflated(cut))] == [(b"HTTP/1.0 200 OK\r\n\r\nbo", True)]
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and warc.warc_date("2001") == "2001-01-01T00:00:00Z"
    ids = [r["record_id"] for r in records.collect()]
    assert len(set(ids)) == len(ids) == 6
    none = pages.limit(0)
    assert warc.convert_arcs(warc.pages_to_arcs(none)).count() == 0


def test_arc_headers():
    """Spaces in the url and the type, a line that fits no version, one without a length, a wrong length."""
    block = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n\n"
    fake = b"http://fake 1.1.1.1 20010203040506 text/html 3"
    data = b"filedesc://n 0.0.0.0 20010101000000 text/plain %d\n" % len(block) + block
    data += b"http://a b c 1.1.1.1 20010203040506 text/html; charset=utf-8 %d\n%s\n\n" % (len(fake) + 1, fake)
    data += b"odd line %d\n%s\n\nno length here\nhttp://d 1.1.1.1 20010203040506 text/html 4\nbody\n" % (len(fake) + 1, fake)
    data += b"http://e 1.1.1.1 20010203040506 text/html 999999999999999999\nrest"
    want = [("http://a b c", "text/html; charset=utf-8", fake + b"\n", False), ("http://d", "text/html", b"body", False), ("http://e", "text/html", b"rest", True)]
    packed = gzip.compress(data[:100]) + b"\0\0" + gzip.compress(data[100:])
    for stored in (data, packed, packed + b"junk"):
        assert [(h["URL"], h["Content-type"], c, t) for h, c, t in warc.arc_records(warc.inflated(stored))] == want
    big = gzip.compress(random.Random(1).randbytes(300_000))
    assert len(warc.inflated(big[:-1000]).read()) > 290_000 and len(warc.inflated(big).read()) == 300_000


def test_foreign_warcs(spark, tmp_path):
    """A warcinfo record, a header line without a colon, no length, a record cut off; members of 16 MB and more."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:a>\r\nodd line\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    bare = b"WARC/1.1\nwarc-type:resource\n\n\r\n\r\n"
    cut = b"WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: x\r\nContent-Length: 100\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(bare) + gzip.compress(cut)[:-8])
    rows = warc.read_warcs(spark, str(tmp_path)).collect()
    assert [(r["record_id"], r["warc_type"], r["page_id"], r["payload_bytes"], r["intact"]) for r in rows] == [("urn:a", "warcinfo", None, 2, True), (None, "resource", None, 0, False), (None, "response", None, 4, False)]
    pages = spark.createDataFrame([(1, "u", "é" * 9_000_000, "x")], "page_id long, url string, html string, payload string")
    records = warc.convert_arcs(warc.pages_to_arcs(pages)).withColumns({"refers_to": F.lit(None).cast("long"), "refers_to_id": F.lit(None).cast("string")})
    warc.write_warcs(records, F.lit(1), str(tmp_path / "w"))
    assert [(r["payload_bytes"], r["intact"]) for r in warc.read_warcs(spark, str(tmp_path / "w")).collect()] == [(18_000_000, True)]


def test_url_reputation(spark):
    """Repeated rows count once; addresses and two-label suffixes make domains of their own; the bound is close to the exact quantile."""
    bad = [(i, f"http://x{i}.ne.jp/") for i in range(40)] + [(100, "http://once.org/")] * 40 + [(101, "http://once.org/a"), (102, "http://once.org/b"), (None, None)] + [(i, f"http://g{i % 10}.org/") for i in range(200, 300)]
    pages = spark.createDataFrame([(*r, "h", 1) for r in bad], "page_id long, url string, host string, bad int")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(40)] + [(100, 0, 0), (101, 1, 0), (102, 1, 0)] + [(i, 1, 0) for i in range(200, 300)], "doc_id long, quality int, host int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, labels).collect()}
    alone = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages.distinct(), labels).collect()}
    assert got == alone and got[100] == "allow" and got[0] == "block"
    hosts = ["10.0.0.1", "192.168.0.1", "[::1]", "a.x.ne.jp", "a.b.co.uk", "b.com", "localhost", ""]
    domain, suffix = url_filter.domain_of(F.col("host"))
    assert [tuple(r) for r in spark.createDataFrame([(h,) for h in hosts], "host string").select(domain, suffix).collect()] == [("10.0.0.1", "ip"), ("192.168.0.1", "ip"), ("[::1]", "ip"), ("x.ne.jp", "ne.jp"), ("b.co.uk", "co.uk"), ("b.com", "com"), ("localhost", "localhost"), ("", "")]
    cases = [(a, b) for a in (1, 2, 5, 20, 100) for b in (1, 2, 5, 20, 100)]
    low = url_filter.lower_bound(F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b"), 1.645)
    x = (np.arange(1_000_000) + 0.5) / 1_000_000
    for (a, b), r in zip(cases, spark.createDataFrame(cases, "a long, b long").select(low.alias("low")).collect(), strict=True):
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - ((a - 1) * np.log(max(a - 1, 1e-9) / max(a + b - 2, 1)) if a > 1 else 0))
        mass = np.cumsum(density)
        assert abs(x[np.searchsorted(mass, 0.04999 * mass[-1])] - r["low"]) < 0.05, (a, b)


def test_url_filter_empty(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int"), RULES).count() == 0


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://U@WWW.Example.com:80/en/x?q"), (2, "HTTP://www.EXAMPLE.com/en/"), (3, "https://a.example.com/en"), (4, None), (5, "no scheme"), (6, "http://x.net/es/?a"), (7, "http://bad.org/1"), (8, "http://bad.org/2"), (9, "ftp://com/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0) for i in range(100, 160)] + [(i, 1) for i in range(160, 400)], "doc_id long, quality int")
    more = spark.range(100, 160).selectExpr("id AS page_id", "'http://bad.org/p' AS url").union(spark.range(160, 400).selectExpr("id", "concat('http://h', id % 6, '.info/')"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages.union(more), labels, RULES).collect()}
    assert got[1] == ("u@www.example.com:80", "/en/x", None, "allow")
    assert got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("a.example.com", "/en", "com/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("x.net", "/es/", "net/es/", "block") and got[7] == ("bad.org", "/1", None, "block") and got[9][2] == "com/"
