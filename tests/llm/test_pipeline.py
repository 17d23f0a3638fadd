"""The five stages against a plain version of each, on the smallest tables."""

import hashlib
import re
from collections import defaultdict

import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quirework.llm import decontaminate, quality
from quirework.llm.queries import VOCABULARY

from .test_llm import edits1, shingle_set

SMALL = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
RULES = quality.LineRules()


def bad_line(x):
    share = lambda p: len(re.findall(p, x)) / len(x)
    if share("[|•·»›]") > RULES.separators or share(quality.SYMBOLS) > RULES.symbols or share("!") > RULES.shouting:
        return True
    if len(x) <= RULES.short and re.search("|".join(quality.BOILERPLATE), x, re.I):
        return True
    return len(x) <= RULES.tiny and not re.search(r"[.!?…。！？:;,)\]\"'»”’][ \t-\r]*$", x)


def cleaned(text):
    w = text.encode().split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = text.split("\n")
    good = [x for x in lines if not x.strip(SPACE) or not bad_line(x)]
    total, kept = sum(map(len, lines)), sum(map(len, good))
    lost = 1 - kept / total if total else 0
    return None if len(w) < 10 or 100 * len(cover) > 20 * len(w) or lost > RULES.most_lost else "\n".join(good)


def test_pipeline(spark):
    import corpus_pipeline

    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    docs = {r["doc_id"]: t for r in sorted(rows, key=lambda r: r["doc_id"]) if (t := cleaned(r["text"])) is not None}

    first = {}
    for i, t in docs.items():
        for k, x in enumerate(t.split("\n")):
            if len(x := x.strip(SPACE)) >= 24:
                first.setdefault(x, (i, k))
    groups = defaultdict(set)
    for x in first:
        groups["a", x[:11]].add(x)
        groups["b", x[-11:]].add(x)
    near = {x for g in groups.values() for x in g for y in g if first[y] < first[x] and edits1(x, y)}
    left = {}
    for i, t in docs.items():
        lines = t.split("\n")
        stay = [x for k, x in enumerate(lines) if len(y := x.strip(SPACE)) < 24 or (first[y] == (i, k) and y not in near)]
        if len(stay) == len(lines) or "".join(stay).strip(SPACE):
            left[i] = "\n".join(stay)

    sets, root = {i: shingle_set(t, 5) for i, t in left.items()}, {i: i for i in left}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {x: new if r == old else r for x, r in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i}

    words = lambda t: re.findall(decontaminate.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + 10]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist() for w in [words(r["text"])] for k in range(max(1, len(w) - 9))}
    clean = {i: t for i, t in left.items() if not any(tuple(w[k : k + 10]) in windows for w in [words(t)] for k in range(len(w) - 9))}
    assert min(map(len, windows)) == 10 and len(clean) < len(left) <= len(docs) < len(rows)

    coder = Tokenizer.from_file(VOCABULARY)
    want = {}
    for i, t in clean.items():
        ids = coder.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


def test_null_and_shared_ids(spark, tmp_path):
    """Rows are taken one by one: a null or shared id takes no other row with it, and of equal rows one stays."""
    import corpus_pipeline

    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    spark.createDataFrame([(1, text("b"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, text("a")), (None, text("c")), (1, text("a")), (2, text("d")), (2, text("d")), (2, text("e")), (3, text("d")), (None, text("f")), (None, text("f")), (None, None), (None, None)]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    want = [(None, text("c")), (1, text("a")), (2, text("d")), (2, text("e")), (None, text("f")), (None, None), (None, None)]
    assert found.columns == ["doc_id", "text"] and sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    rows = [(None, text("b")), (None, text("a")), (1, text("c") + " " + text("b")), (1, text("d")), (2, text("b")), (3, None)]
    found = corpus_pipeline.benchmark_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(None, text("a")), (1, text("d")), (3, None)], key=repr)
