"""Whole runs with providers that count: cache, resume, fatal errors, demonstrations; parsing and output; workspaces."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quirework.functions.text import content_id
from quirework.operators import evaluate, run
from quirework.operators.provider import ProviderError
from quirework.sources import readers, sinks, workspace

BLOCKS = "document_id string, page int, position long, block_id string, block_type string, section string, text string, warnings array<string>"
TEXTS = [("title", "The title"), ("paragraph", "Gain of 300 MHz and 5%."), ("paragraph", "Plain words only."), ("paragraph", "Domain alignment in [1, 2]."), ("reference", "[1] Someone."), ("paragraph", "As Fig. 3 shows, x rises.")]
OPTIONS = run.Options(target_language="zh", model="m", identity="id:m")


def inputs(spark, documents=("d",)):
    rows = [(d, 1, i, f"b{i}", kind, "s", text, []) for d in documents for i, (kind, text) in enumerate(TEXTS)]
    blocks = spark.createDataFrame(rows, BLOCKS)
    pages = spark.createDataFrame([(d, 1, False, "single_column") for d in documents], "document_id string, page int, requires_ocr boolean, layout string")
    return blocks, pages, spark.createDataFrame([(d, []) for d in documents], "document_id string, warnings array<string>")


def provider(answer=lambda text: "→ " + text, fails="", fatal=False):
    def make():
        def complete(text, user):
            assert json.loads(user)["current_text"] == text
            if fails in text if fails else fatal:
                raise ProviderError("no", fatal)
            return answer(text)

        return complete

    return make


@pytest.fixture
def translated(spark, tmp_path):
    """A run, in a new folder each time; its one document's row comes with it."""
    n = iter(range(100))

    def go(make, options=OPTIONS, cache=None, previous=None, documents=("d",)):
        out = run.translate_blocks(*inputs(spark, documents), options, make, str(tmp_path / f"run{next(n)}"), cache, previous)
        return out, out.documents.orderBy("document_id").first()

    return go


def origins(out):
    return {r["block_id"]: r["origin"] for r in out.blocks.collect()}


def test_second_run_calls_nothing(spark, translated, tmp_path):
    cache = str(tmp_path / "cache")
    first, row = translated(provider(), cache=cache)
    assert (row["status"], row["provider_calls"], row["retained_blocks"], row["cache_hits"], row["mode"]) == ("completed", 5, 1, 0, "live")
    assert {r["check"]["passed"] for r in first.blocks.filter("origin = 'provider'").collect()} == {True}
    assert first.blocks.filter("block_id = 'b1'").first()["translation"] == "→ Gain of 300 MHz and 5%."
    again, row = translated(provider(fatal=True), cache=cache)
    assert (row["provider_calls"], row["cache_hits"], row["status"]) == (0, 5, "completed")
    assert set(origins(again).values()) == {"cache", "retained"}
    _, row = translated(provider(), cache=cache, options=replace(OPTIONS, target_language="ja"))
    assert row["provider_calls"] == 5


def test_what_fails_the_check_is_not_cached(translated, tmp_path):
    cache = str(tmp_path / "cache")
    first, row = translated(provider(lambda text: "all lost"), cache=cache)
    risky = first.blocks.filter("not check.passed").count()
    assert row["status"] == "partial" and risky == 3 and any(w.startswith("MissingPlaceholder") for r in first.blocks.collect() for w in r["warnings"])
    _, row = translated(provider(lambda text: "all lost"), cache=cache)
    assert (row["provider_calls"], row["cache_hits"], row["status"]) == (risky, 2, "partial")


def test_resume(spark, translated, tmp_path):
    broken, row = translated(provider(fails="Domain"))
    assert (row["status"], row["failed_blocks"]) == ("partial", 1)
    whole, row = translated(provider(), replace(OPTIONS, retry="failed"), previous=broken)
    assert (row["status"], row["provider_calls"], row["resumed_blocks"]) == ("completed", 1, 4)
    assert [b for b, o in origins(whole).items() if o == "resume"] != [] and {r["check"]["passed"] for r in whole.blocks.filter("origin = 'resume'").collect()} == {True}
    # One check that failed, one answer that no longer restores, one explanation to carry on.
    changed = whole.blocks.withColumn("check", F.when(F.col("block_id") == "b2", F.struct(F.lit(False).alias("passed"), F.lit(0.5).alias("risk_score"), F.col("check.errors").alias("errors"))).otherwise(F.col("check")))
    changed = changed.withColumn("raw", F.when(F.col("block_id") == "b3", "broken").otherwise(F.col("raw")))
    told = F.struct(F.lit("o").alias("original"), F.lit("t").alias("translation"), F.lit("p").alias("plain_explanation"), F.lit("r").alias("role_in_paper"), F.array().cast("array<struct<term:string,explanation:string>>").alias("key_terms"), F.lit("w").alias("warning"))
    changed = changed.withColumn("explanation", F.when(F.col("block_id") == "b5", told).otherwise(F.col("explanation")))
    changed.write.parquet(str(tmp_path / "changed"))
    before = whole._replace(blocks=spark.read.parquet(str(tmp_path / "changed")))
    _, row = translated(provider(), replace(OPTIONS, retry="failed"), previous=before)
    assert (row["provider_calls"], row["resumed_blocks"]) == (1, 4)
    risky, row = translated(provider(), replace(OPTIONS, retry="risky"), previous=before)
    assert (row["provider_calls"], row["resumed_blocks"]) == (2, 3) and origins(risky)["b2"] == "provider"
    assert risky.blocks.filter("block_id = 'b5'").first()["explanation"]["plain_explanation"] == "p"
    cache = str(tmp_path / "cache")
    translated(provider(), cache=cache)
    _, row = translated(provider(), replace(OPTIONS, retry="all"), cache=cache, previous=before)
    assert (row["provider_calls"], row["cache_hits"], row["resumed_blocks"]) == (5, 0, 0)


def test_what_a_run_leaves(spark, tmp_path, monkeypatch):
    """Beside the results nothing, no shuffle file either, and texts that repeat each other once; in parts as in one go, and with a cache as with a previous run."""
    import random

    monkeypatch.setattr(run, "SMALL", -1, raising=False)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(name.startswith("shuffle_") for name in local.getAllFiles().mkString("\n").replace("/", "\n").split("\n"))
    letters, documents = random.Random(0), [f"d{i}" for i in range(20)]
    rows = [(d, 1, i, f"b{i}", "paragraph", f"s{i % 2}", " ".join("".join(letters.choices("abcdefghijklmnop", k=9)) for _ in range(90)) + " in Fig. 3", []) for d in documents for i in range(6)]
    blocks, (_, pages, docs) = spark.createDataFrame(rows, BLOCKS), inputs(spark, documents)
    size = lambda path: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    cache, before = str(tmp_path / "cache"), shuffled()
    first = run.translate_blocks(blocks, pages, docs, OPTIONS, provider(), str(tmp_path / "first"), cache)
    assert size(tmp_path / "first" / "blocks") < 1.5 * sum(len(r[6]) for r in rows)
    resumed = run.translate_blocks(blocks, pages, docs, replace(OPTIONS, retry="failed"), provider(fatal=True), str(tmp_path / "second"), None, first)
    cached = run.translate_blocks(blocks, pages, docs, OPTIONS, provider(fatal=True), str(tmp_path / "third"), cache)
    assert {p.name for run_ in ("first", "second", "third") for p in (tmp_path / run_).iterdir()} == {"blocks", "documents"}
    assert shuffled() <= before
    for out, count in ((resumed, "resumed_blocks"), (cached, "cache_hits")):
        assert {(r["status"], r[count], r["provider_calls"]) for r in out.documents.collect()} == {("completed", 6, 0)}
        same = [*(c for c in first.blocks.columns if c not in ("origin", "called"))]
        assert out.blocks.select(same).exceptAll(first.blocks.select(same)).count() == 0 and out.blocks.count() == len(rows)


def test_resume_refusals(translated):
    before, _ = translated(provider())
    for options in (replace(OPTIONS, retry="failed", target_language="ja"), replace(OPTIONS, retry="failed", model="other"), OPTIONS, replace(OPTIONS, retry="failed", demo=True), replace(OPTIONS, retry="sometimes")):
        with pytest.raises(ValueError):
            translated(provider(), options, previous=before)
    with pytest.raises(ValueError):
        translated(provider(), replace(OPTIONS, retry="failed"))
    demo, _ = translated(None, replace(OPTIONS, demo=True))
    with pytest.raises(ValueError):
        translated(provider(), replace(OPTIONS, retry="failed"), previous=demo)


def test_fatal_errors(translated, tmp_path):
    """One call for each document; behind it not even the cache is used."""
    out, row = translated(provider(fatal=True), documents=("d", "e"))
    assert (row["provider_calls"], row["failed_blocks"], row["status"]) == (1, 5, "partial")
    assert out.blocks.filter("called").count() == 2 and {r["check"]["errors"][0]["type"] for r in out.blocks.filter("origin = 'provider'").collect()} == {"TranslationFailed"}
    cache = str(tmp_path / "cache")
    translated(provider(fails="Plain"), cache=cache)

    def refusing():
        def complete(text, user):
            raise ProviderError("no", True)

        return complete

    out, row = translated(refusing, cache=cache)
    assert (row["cache_hits"], row["provider_calls"], row["failed_blocks"]) == (2, 1, 3)
    assert [b for b, o in sorted(origins(out).items()) if o == "cache"] == ["b0", "b1"]


def test_long_blocks_are_not_cut(translated):
    _, row = translated(provider(), replace(OPTIONS, most_chars=10))
    assert (row["provider_calls"], row["failed_blocks"]) == (5, 4)


def test_demonstration(translated, tmp_path):
    out, row = translated(None, replace(OPTIONS, demo=True), cache=str(tmp_path / "cache"))
    assert (row["mode"], row["provider_calls"], row["status"]) == ("demo", 0, "completed") and row["warnings"] == [run.DEMO_NOTICE]
    assert {r["check"]["passed"] for r in out.blocks.filter("origin = 'demo'").collect()} == {False} and not (tmp_path / "cache").exists()


def test_from_files_to_pages(spark, tmp_path):
    """Files through a reader of one line a span, parsing, a run and the output."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("A study of waves\nAbstract\nWaves of 300 MHz rise and fall in every sea.\nReferences\n[1] Someone, somewhere.")
    (tmp_path / "in" / "bad.txt").write_text("?")

    def reader(content):
        if content == b"?":
            raise ValueError("no such format")
        for i, text in enumerate(content.decode().split("\n")):
            yield {"page": 1, "width": 600.0, "height": 800.0, "native": i, "type": 0, "line_no": 0, "span_no": 0, "text": text, "x0": 50.0, "y0": 50.0 + 40 * i, "x1": 500.0, "y1": 62.0 + 40 * i, "dir_y": 0.0, "font_size": 21.0 if i == 0 else 14.0 if len(text) < 15 else 10.0, "font_name": "f", "flags": 0}

    spans = readers.read_files(spark, str(tmp_path / "in"), reader)
    assert [r["filename"] for r in spans.filter("error is not null").collect()] == ["bad.txt"]
    parsed = run.parse_spans(spans.filter("error is null"))
    for name, table in parsed._asdict().items():
        table.write.parquet(str(tmp_path / name))
    parsed = run.Parsed(*(spark.read.parquet(str(tmp_path / name)) for name in parsed._fields))
    kinds = [r["block_type"] for r in parsed.blocks.orderBy("position").collect()]
    assert kinds == ["title", "section_title", "paragraph", "section_title", "reference"] and parsed.documents.first()["title"] == "A study of waves"
    out = run.translate_blocks(parsed.blocks, parsed.pages, parsed.documents, OPTIONS, provider(), str(tmp_path / "run"))
    assert out.documents.first()["status"] == "completed" and out.documents.first()["provider_calls"] == 4
    blocks = out.blocks.drop("width", "height")
    sinks.export(blocks, parsed.pages, out.documents, str(tmp_path / "out"))
    page = spark.read.parquet(str(tmp_path / "out" / "html")).first()
    assert page["verified"] == 4 and "300 MHz" in page["html"] and "<AP" not in page["html"]
    tree = spark.read.json(str(tmp_path / "out" / "json")).first()
    assert [b["block_type"] for p in tree["pages"] for b in p["blocks"]] == kinds


def test_a_resumed_run_shuffles_its_texts_once(spark, tmp_path, monkeypatch):
    """What waits are blocks as they came; neither they nor requests made of them are shuffled again. Blocks that are new, changed or failed before are asked for."""
    import random

    sc, letters = spark.sparkContext, random.Random(1)

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    documents = [f"d{i}" for i in range(40)]
    rows = [(d, 1, i, f"b{i}", "paragraph", f"s{i % 2}", " ".join("".join(letters.choices("abcdefghijklmnop", k=9)) for _ in range(90)) + " in Fig. 3", []) for d in documents for i in range(8)]
    _, pages, docs = inputs(spark, documents)
    failing = rows[5][6][:40]
    first = run.translate_blocks(spark.createDataFrame(rows, BLOCKS), pages, docs, OPTIONS, provider(fails=failing), str(tmp_path / "first"))
    changed = [(*r[:6], "Another text.", []) if r[0] == "d7" and r[2] == 3 else r for r in rows] + [("d8", 1, 8, "b8", "paragraph", "s0", "New.", [])]
    texts, waiting, finish = sum(len(r[6]) for r in changed), [], run._finish
    monkeypatch.setattr(run, "SMALL", -1)
    monkeypatch.setattr(run, "_finish", lambda *a: (waiting.append(sum(f.stat().st_size for f in (tmp_path / "second").rglob("*.parquet") if "/blocks/" not in str(f))), finish(*a))[1])
    before = shuffled()
    again = run.translate_blocks(spark.createDataFrame(changed, BLOCKS), pages, docs, replace(OPTIONS, retry="failed"), provider(), str(tmp_path / "second"), None, first)
    assert shuffled() - before < 2.5 * texts
    assert waiting == sorted(waiting, reverse=True) and 0 < waiting[-1] < texts / 4
    found = {(r["document_id"], r["block_id"]): (r["origin"], r["text"], r["translation"]) for r in again.blocks.collect()}
    asked = {("d0", "b5"), ("d7", "b3"), ("d8", "b8")}
    assert found == {(r[0], r[3]): ("provider" if (r[0], r[3]) in asked else "resume", r[6], "→ " + r[6]) for r in changed}


def test_newest_cache_entry(spark, tmp_path):
    from quirework.operators.translate import cache_lookup

    path = str(tmp_path / "cache")
    for raw in ("zz old", "aa new"):
        sinks.write_cache(spark.createDataFrame([("ab", 1, raw)], "key string, schema_version int, raw_translation string"), path)
    assert cache_lookup(spark.createDataFrame([("ab",)], "key string"), spark.read.parquet(path)).first()["cached"] == "aa new"


def test_workspace(spark, tmp_path):
    """Init, add, refuse, validate, evaluate."""
    path = str(tmp_path / "ws")
    with pytest.raises(ValueError):
        workspace.load_workspace(spark, path)
    workspace.init_workspace(spark, path, "set")
    with pytest.raises(ValueError):
        workspace.init_workspace(spark, path, "set")
    files = spark.createDataFrame([("a.pdf", bytearray(b"A")), ("b.pdf", bytearray(b"B"))], "filename string, content binary").withColumn("document_id", content_id(F.col("content")))
    ids = [r[0] for r in files.orderBy("filename").select("document_id").collect()]
    blocks = spark.createDataFrame([(d, 1, i, f"b{i}", kind, text, "") for d in ids for i, (kind, text) in enumerate(TEXTS)], "document_id string, page int, position long, block_id string, block_type string, text string, translation string")
    workspace.add_documents(files.filter("filename = 'a.pdf'"), blocks, path)
    for wrong in (files, files.filter("filename = 'b.pdf'").withColumn("document_id", F.lit(ids[0])), files.filter("filename = 'b.pdf'").union(files.filter("filename = 'b.pdf'"))):
        with pytest.raises(ValueError):
            workspace.add_documents(wrong, blocks, path)
    with pytest.raises(ValueError):
        workspace.add_documents(files.filter("filename = 'b.pdf'"), blocks.limit(0), path)
    workspace.add_documents(files.filter("filename = 'b.pdf'"), blocks, path, split="test")
    name, manifest = workspace.load_workspace(spark, path)
    assert name == "set" and {r["document_id"]: r["split"] for r in manifest.collect()} == {ids[0]: "calibration", ids[1]: "test"}
    own, pages, labels = workspace.labelled(spark, path)
    assert evaluate.workspace_errors(own, manifest, pages, labels).count() == 0
    reviewed = labels.withColumns({"protection_reviewed": F.lit(True), "block_type_reviewed": F.lit(True)})
    turned = pages.withColumns({"reading_order_reviewed": F.lit(True), "expected_order": F.reverse("expected_order")})
    row = evaluate.summary(name, own, manifest, turned, reviewed).first()
    assert (row["documents"], row["reading_order_pair_accuracy"], row["guard_f1"], row["block_type_accuracy"], row["translations_reviewed"], row["translation_pass_rate"], row["warnings"]) == (2, 0.0, 1.0, 1.0, 0, None, [])
    stale = own.withColumn("text", F.when((F.col("document_id") == ids[0]) & (F.col("block_id") == "b2"), "other").otherwise(F.col("text")))
    errors = evaluate.workspace_errors(stale, manifest, pages, labels).collect()
    assert {r["place"] for r in errors} == {"", "b2"} and {r["document_id"] for r in errors} == {ids[0]}
    row = evaluate.summary(name, stale, manifest, turned, reviewed).first()
    assert row["documents"] == 2 and row["block_types_reviewed"] == len(TEXTS) and len(row["warnings"]) == len(errors)
