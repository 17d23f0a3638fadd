"""Small cases for what the queries don't reach."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quirework.functions.tokens import covered, named_tokens, rule_values, tokens_in, uncovered
from quirework.operators import context, explain, translate, verify
from quirework.operators.provider import Client, ProviderError, content_of
from quirework.sources import config, readers, sinks


@pytest.mark.parametrize(
    "text, values",
    [
        ("gain of 300 MHz", ["300", "MHz"]), ("up to 1,234,567 and −.25", ["1,234,567", "−.25"]), ("see [1, 2–4]", ["[1, 2–4]"]), ("Fig. 3 and Table II", ["Fig. 3", "Table II"]), ("a drop of .05%", [".05%"]),
        ("$x_1$ with α_2", ["$x_1$", "α_2"]), ("DNA and H2", ["DNA", "H2"]), ("no tokens here", []), ("2.5 × 10^-3", ["2.5 × 10^-3"]), ("<APab_NUM_001> stays", ["<APab_NUM_001>"]),
    ],
)
def test_tokens(text, values):
    assert [t["value"] for t in tokens_in(text)] == values
    named = named_tokens(text)
    assert uncovered(covered(text, named), [(t[0], t[2]) for t in named]) == (text, [])


def test_damaged_placeholders():
    named = named_tokens("12 and 12")
    text, values, first = covered("12 and 12", named), [(t[0], t[2]) for t in named], named[0][0]
    assert uncovered(text.replace(first, ""), values)[1] == [f"MissingPlaceholder: {first}"]
    doubled, notes = uncovered(text + first, values)
    assert [n.split(":")[0] for n in notes] == ["DuplicatePlaceholder"] and doubled.count(first) == 2
    assert uncovered("<APff_NUM_001>", []) == ("<APff_NUM_001>", ["UnknownPlaceholder: <APff_NUM_001>"])
    assert [n.split(":")[0] for n in uncovered(text, [*values, (first, "x")])[1]] == ["InvalidProtectionMap"]
    stem = first[3:15]
    assert named_tokens("12 and 12")[0][0].startswith(f"<AP{stem}_") and named_tokens(f"<AP{stem}_ 5")[0][0] != first


def test_rules_on_long_texts(spark):
    """Runs of a million characters go through Java's engine without a deep stack, and digits of all scripts count."""
    texts = ["1," + "234," * 2_000 + "5", "[" + "1, " * 20_000 + "2]", "[1" + " " * 20_000 + "x", "٣٤ mm", "−.5% and 1,234.5 kHz", "12_ x1 1e5"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(*[c.alias(n) for n, c in rule_values(F.col("t")).items()]).collect()
    assert len(found[1]["CitationMismatch"][0]) > 40_000 and found[2]["NumberMismatch"] == ["1"] and found[3]["NumberMismatch"] == ["٣٤"] and found[3]["QuantityMismatch"] == ["٣٤ mm"]
    assert found[4]["PercentageMismatch"] == ["−.5%"] and found[4]["QuantityMismatch"] == ["1,234.5 kHz"] and found[5]["NumberMismatch"] == ["1e5"]


def test_counts_json(spark):
    rows = spark.createDataFrame([(["a", "b", " a"],), ([],), (["x "],)], "v array<string>").select(verify.counts_json(F.col("v")).alias("j")).collect()
    assert [json.loads(r["j"]) for r in rows] == [{"a": 2, "b": 1}, {}, {"x": 1}]


def test_check_pairs(spark):
    pairs = [("5 GHz", "6 GHz", ["NumberMismatch", "QuantityMismatch"]), ("a [1]", "a", ["NumberMismatch", "CitationMismatch"]), ("10 mm and 2 s", "2 mm and 10 s", ["QuantityMismatch"]), ("x", " ", ["EmptyTranslation"]), ("Fig. 1, 3%", "3% in Fig.1", []), ("", "", [])]
    df = verify.check(spark.createDataFrame(pairs, "source string, translation string, want array<string>"))
    assert all([e["type"] for e in r["check"]["errors"]] == r["want"] for r in df.collect())


def test_budget_and_key(spark):
    df = spark.createDataFrame([("s" * 500, "{}", "p" * 500, "n" * 500)], "section string, terminology string, previous string, next string")
    r = context.bounded(df, 100).first()
    assert sum(map(len, r)) == 100
    with pytest.raises(ValueError):
        context.bounded(df, -1)


def test_resume_rules():
    new = {"document_id": "d", "target_language": "zh", "model": "m"}
    translate.validate_previous(new, {**new, "mode": "live"}, "failed")
    for old, retry in (({**new, "mode": "demo"}, "failed"), ({**new, "model": "x", "mode": "live"}, "failed"), ({**new, "mode": "live"}, "none"), (None, "all")):
        with pytest.raises(ValueError):
            translate.validate_previous(new, old, retry)


def test_provider_answers():
    good = {"choices": [{"message": {"content": " ok "}, "finish_reason": "stop"}]}
    assert content_of(json.dumps(good).encode()) == "ok"
    for bad in ([], None, {"choices": {}}, {"choices": [1]}, {"choices": [{"message": {"content": 5}}]}, {}, {"choices": []}, {"choices": [{"message": {"content": ""}}]}, {"choices": [{"message": {"content": "x"}, "finish_reason": "length"}]}):
        with pytest.raises(ProviderError):
            content_of(json.dumps(bad).encode())
    for url, more in (("http://u:p@host", {}), ("http://:p@host", {}), ("ftp://host", {}), ("http://host?x=1", {}), ("http://host", {"timeout": float("nan")}), ("http://host", {"retries": 6})):
        with pytest.raises(ValueError):
            Client(url, "m", "k", **more)
    assert "secret" not in repr(Client("http://host", "m", "secret"))


def test_provider_over_http():
    answers = [500, 200, 401]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            code = answers.pop(0)
            body = json.dumps({"choices": [{"message": {"content": "fine"}}]}).encode() if code == 200 else b"{}"
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = Client(f"http://127.0.0.1:{server.server_port}", "m", "k", sleep=lambda s: None)
    assert client.complete("hello") == "fine"
    with pytest.raises(ProviderError) as e:
        client.complete("hello")
    assert e.value.fatal
    server.shutdown()


def test_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"a": "b"}')
    assert readers.read_glossary(spark, str(tmp_path / "g.json")).collect() == [("a", "b")]
    (tmp_path / "g2.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        readers.read_glossary(spark, str(tmp_path / "g2.json"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "ab1.json").write_text('{"schema_version": 1, "raw_translation": "x"}')
    (tmp_path / "c" / "ab2.json").write_text("broken")
    asked = spark.createDataFrame([("ab1",), ("ab2",), ("ab3",)], "key string")
    assert {r["key"]: r["cached"] for r in translate.cache_lookup(asked, readers.read_cache(spark, str(tmp_path / "c"))).collect()} == {"ab1": "x", "ab2": None, "ab3": None}
    doc = {"document_id": "d", "pages": [{"page": 1, "width": 600.0, "height": 800.0, "blocks": [{"block_id": "b", "bbox": [0.0, 1.0, 2.0, 3.0], "text": "t", "confidence": 1.0}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    row = readers.blocks_of(readers.read_documents(spark, str(tmp_path / "d.json"))).first()
    assert (row["x1"], row["translation_status"], row["translation_origin"]) == (2.0, "pending", "none")
    with pytest.raises(ValueError):
        config.inside(str(tmp_path), "../x")
    for wrong in ({"timeout": 0}, {"timeout": float("nan")}, {"timeout": float("inf")}, {"max_retries": 6}, {"max_retries": -1}, {"context_chars": -1}, {"max_current_chars": 0}):
        with pytest.raises(ValueError):
            config.Settings(**wrong)
    assert "k" not in repr(config.Settings(api_key="k")).replace("max_tokens", "").split("api_base_url")[0]


def test_explanations(spark):
    """One fence is taken off; other types, missing parts and trailing text are refused."""
    good = '{"plain_explanation": "a", "role_in_paper": "b", "key_terms": [{"term": "t", "explanation": "e"}]}'
    two = '{"plain_explanation": "a", "role_in_paper": "b"%s}'
    fine = [good, f"```json\n{good}\n```", two % "", two % ', "key_terms": []', two % ', "more": 1']
    bad = ["{}", "x", "", None, "null", "[1]", good + " trailing", f"{good}, {good}", f"{good}] [", f"{good}}} {{", '{"plain_explanation": 5, "role_in_paper": "b"}', '{"plain_explanation": "", "role_in_paper": "b"}', '{"plain_explanation": {"x": 1}, "role_in_paper": "b"}']
    bad += [two % f', "key_terms": {x}' for x in ("null", "{}", '"x"', "[1]", '[{"term": "t"}]', '[{"term": "t", "explanation": 3}]', json.dumps([{"term": "t", "explanation": "e"}] * 31))]
    rows = {r["raw"]: r["explanation"] for r in explain.parsed(spark.createDataFrame([(x,) for x in fine + bad], "raw string")).collect()}
    assert [x for x in fine if rows[x] is None] == [] and [x for x in bad if rows[x] is not None] == []
    assert rows[good]["key_terms"][0]["explanation"] == "e" and rows[fine[2]]["key_terms"] == []


def test_scan_is_the_grammar():
    """Looking at first characters, and leaving out texts that RE2 finds nothing in, changes no token."""
    import random
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    from quirework.functions import tokens

    plain = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in tokens.GRAMMAR.items()))
    pieces = [*"abxyzgmsEFT .,-+−_$\\[]()%0123٣９μµ°αΩé–’ÿ₂²\n\t", "Fig", "Figs.", "Table", "Eq.", "IV", "MHz", "kHz", "<AP", "<APab_NUM_1>", "10^", "e5", "AB", "H2", "x_1", "\\(", "\\)", "$$", "[1, 2]", "μm", "×10"]
    r = random.Random(2)
    texts = ["".join(r.choices(pieces, k=r.randint(0, 14))) for _ in range(20000)]
    for text, likely in zip(texts, pc.match_substring_regex(pa.array(texts), tokens.LIKELY).to_pylist(), strict=True):
        want = [(m.lastgroup, m.span()) for m in plain.finditer(text)]
        assert [(m.lastgroup, m.span()) for m in tokens.SCAN.finditer(text)] == want and (likely or not want)
