"""One query for each operator of the inventory, beside the same result in SQL.

"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.text import content_id, html_escape
from ..operators import classify, context, evaluate, explain, layout, run, segment, translate, verify
from ..sources import sinks
from ..sources.scratch import delete, scratch
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# F, G: tokens and verification


@query(f"WITH {fx.SENTENCES_SQL} SELECT kind, (SELECT count(*) FROM s) AS n FROM (VALUES ('REF'), ('NUM'), ('UNIT'), ('PERCENT'), ('CIT')) v(kind)")
def tok_counts_by_kind(spark, d):
    """F1 to F7."""
    return fx.sentences(spark, d).select(F.explode(tokens.scan("source")).alias("t")).groupBy(F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {fx.SENTENCES_SQL}, a AS (SELECT c, length(n::VARCHAR) AS ln, length(q::VARCHAR) AS lq, length(d::VARCHAR) AS ld, length(k::VARCHAR) AS lk FROM s),
e AS (SELECT c, 'REF' AS kind, 0 AS b, 5 + ln AS e FROM a UNION ALL SELECT c, 'NUM', 12 + ln, 12 + ln + lq FROM a UNION ALL SELECT c, 'UNIT', 13 + ln + lq, 16 + ln + lq FROM a
UNION ALL SELECT c, 'PERCENT', 20 + ln + lq, 21 + ln + lq + ld FROM a UNION ALL SELECT c, 'CIT', 22 + ln + lq + ld, 24 + ln + lq + ld + lk FROM a)
SELECT c, kind, sum(b)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM e GROUP BY c, kind""")
def tok_offsets(spark, d):
    """offsets in code points, half open."""
    t = fx.sentences(spark, d).select("c", F.explode(tokens.scan("source")).alias("t"))
    return t.groupBy("c", F.col("t.kind").alias("kind")).agg(F.sum("t.start").alias("starts"), F.sum("t.end").alias("ends"))


@query(f"WITH {fx.SENTENCES_SQL} SELECT c, count(*) AS n, count(*) AS same, count(*) AS valid, 5 * count(*) AS items FROM s GROUP BY c")
def protect_restore_roundtrip(spark, d):
    """F8 to F10."""
    rows = translate.protected(fx.sentences(spark, d).withColumnRenamed("source", "text")).withColumn("r", tokens.restore("protected_text", "items"))
    return rows.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("r.text") == F.col("text")).alias("same"), F.count_if(F.size("r.warnings") == 0).alias("valid"), F.sum(F.size("items")).cast("long").alias("items"))


def damaged(spark, d) -> DataFrame:
    """Protected sentences of which every second loses, doubles or renames its first placeholder."""
    rows = translate.protected(fx.sentences(spark, d).withColumnRenamed("source", "text")).withColumn("first", F.get("items", F.lit(0))["placeholder"])
    new = F.when(F.col("c") % 4 == 1, "").when(F.col("c") % 4 == 2, F.concat("first", F.lit(" "), "first")).when(F.col("c") % 4 == 3, F.replace("first", F.lit("_001>"), F.lit("_999>"))).otherwise(F.col("first"))
    return rows.withColumn("raw", F.replace("protected_text", F.col("first"), new))


@query(f"WITH {fx.SENTENCES_SQL} SELECT * FROM (SELECT 'missing' AS issue, count(*) AS n FROM s WHERE c % 4 IN (1, 3) UNION ALL SELECT 'double', count(*) FROM s WHERE c % 4 = 2 UNION ALL SELECT 'unknown', count(*) FROM s WHERE c % 4 = 3) WHERE n > 0")
def placeholder_audit(spark, d):
    """by a full outer join of counts."""
    found = verify.placeholder_audit(damaged(spark, d), ["o", "n", "part", "k", "q", "d"])
    issue = F.when(F.col("expected") == 0, "unknown").when(F.col("found") == 0, "missing").otherwise("double")
    return found.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.SENTENCES_SQL} SELECT c, count(*) AS n, CASE WHEN c % 4 = 0 THEN 0 WHEN c % 4 = 3 THEN 2 ELSE 1 END * count(*) AS warnings FROM s GROUP BY c")
def restore_warnings(spark, d):
    """the warnings of restoring the same texts."""
    rows = damaged(spark, d).withColumn("r", tokens.restore("raw", "items"))
    return rows.groupBy("c").agg(F.count("*").alias("n"), F.sum(F.size("r.warnings")).cast("long").alias("warnings"))


ERRORS_SQL = """e AS (SELECT 'UnitMismatch' AS t, 0 AS c UNION ALL SELECT 'QuantityMismatch', 0 UNION ALL SELECT 'NumberMismatch', 1 UNION ALL SELECT 'CitationMismatch', 1 UNION ALL SELECT 'NumberMismatch', 2 UNION ALL SELECT 'QuantityMismatch', 2 UNION ALL SELECT 'NumberMismatch', 6
UNION ALL SELECT unnest(['NumberMismatch', 'PercentageMismatch', 'UnitMismatch', 'CitationMismatch', 'FigureTableReferenceMismatch', 'QuantityMismatch', 'EmptyTranslation']), 3)"""


@query(f"WITH {fx.SENTENCES_SQL}, {ERRORS_SQL} SELECT e.t AS error_type, count(*) AS n FROM s JOIN e ON s.c = e.c GROUP BY e.t")
def rule_mismatch_counts(spark, d):
    """G1, G2, G5."""
    return verify.check(fx.sentences(spark, d)).select(F.explode("check.errors").alias("e")).groupBy(F.col("e.type").alias("error_type")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.SENTENCES_SQL} SELECT c, count(*) AS n, CASE WHEN c IN (0, 1, 2) THEN 0.5 WHEN c = 3 THEN 1.0 WHEN c = 6 THEN 0.25 ELSE 0.0 END::DOUBLE AS risk, CASE WHEN c IN (0, 1, 2, 3, 6) THEN 0 ELSE count(*) END AS passed FROM s GROUP BY c")
def risk_scores(spark, d):
    """G6."""
    return verify.check(fx.sentences(spark, d)).groupBy("c").agg(F.count("*").alias("n"), F.max("check.risk_score").alias("risk"), F.count_if("check.passed").alias("passed"))


@query(f"WITH {fx.SENTENCES_SQL} SELECT c, CASE WHEN c = 5 OR c >= 7 OR c = 4 THEN 0 ELSE count(*) END AS mismatched, CASE c WHEN 5 THEN 0.0 WHEN 4 THEN 0.0 WHEN 6 THEN 0.5 WHEN 3 THEN 1.0 WHEN 0 THEN 0.75 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 ELSE 0.0 END::DOUBLE AS risk FROM s GROUP BY c")
def stored_item_check(spark, d):
    """A rescan of the translation against the stored items."""
    rows = fx.sentences(spark, d).withColumn("items", tokens.protect("source")["items"])
    checked = verify.check(rows, items="items")
    return checked.groupBy("c").agg(F.count_if(F.exists("check.errors", lambda e: e["type"] == "ProtectedTokenMismatch")).alias("mismatched"), F.max("check.risk_score").alias("risk"))


@query(f"WITH {fx.SENTENCES_SQL} SELECT c, CASE WHEN c = 4 THEN count(*) ELSE 0 END AS unchanged, CASE WHEN c IN (0, 1, 2, 4) THEN 0.5 WHEN c = 3 THEN 1.0 WHEN c = 6 THEN 0.25 ELSE 0.0 END::DOUBLE AS risk FROM s GROUP BY c")
def unchanged_paragraphs(spark, d):
    """The risk of an unchanged paragraph is at least one half."""
    rows = verify.check(fx.sentences(spark, d)).withColumns({"block_type": F.lit("paragraph"), "warnings": F.array().cast("array<string>")})
    return verify.flag_unchanged(rows).groupBy("c").agg(F.count_if(F.size("warnings") == 1).alias("unchanged"), F.max("check.risk_score").alias("risk"))


@query(f"WITH {fx.SENTENCES_SQL} SELECT c, count(*) AS n, least(1.0, CASE WHEN c % 4 = 0 THEN 0 WHEN c % 4 = 3 THEN 3 ELSE 2 END * 0.25)::DOUBLE AS least_risk, 0::BIGINT AS clean_errors FROM s GROUP BY c")
def placeholder_errors(spark, d):
    """One error for each warning of restoring, beside the mismatch of tokens that it brings. clean_errors: undamaged rows with an error."""
    rows = damaged(spark, d).withColumn("r", tokens.restore("raw", "items")).select("c", "text", "items", F.col("r.text").alias("out"), F.col("r.warnings").alias("notes"))
    kinds = F.filter("check.errors", lambda e: e["type"].isin("PlaceholderIntegrityError", "ProtectedTokenMismatch"))
    checked = verify.check(rows, "text", "out", "items", "notes").groupBy("c")
    return checked.agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.min(F.size(kinds)) * 0.25).alias("least_risk"), F.count_if((F.col("c") % 4 == 0) & (F.size(kinds) > 0)).alias("clean_errors"))


@query(f"WITH {fx.SENTENCES_SQL} SELECT c, 'DemoNotTranslation' AS error_type, count(*) AS n FROM s GROUP BY c")
def demo_runs(spark, d):
    """G8, H16."""
    rows = translate.protected(fx.sentences(spark, d).withColumnRenamed("source", "text")).withColumns({"raw": translate.demo_raw(F.col("protected_text")), "block_type": F.lit("paragraph"), "warnings": F.array().cast("array<string>")})
    done = translate.apply_raw(rows, demo=True).filter("check.risk_score = 1 and translation_status = 'demo' and translation = concat(:p, text)".replace(":p", "'" + translate.DEMO_PREFIX.replace("\n", "\\n") + "'"))
    return done.select("c", F.explode("check.errors").alias("e")).groupBy("c", F.col("e.type").alias("error_type")).agg(F.count("*").alias("n"))


# A, C: ingest and segmentation

PARTS_SQL = f"""{fx.GEOMETRY_SQL}, w AS (SELECT *, lag(x0) OVER v AS px, lag(y0) OVER v AS py, lag(y1) OVER v AS pb, lag(size) OVER v AS ps FROM gl WINDOW v AS (PARTITION BY document_id, page, native ORDER BY line_no)),
f AS (SELECT *, CASE WHEN px IS NOT NULL AND (abs(x0 - px) > 210 OR y0 < py - 3 OR y0 - pb > ps) THEN 1 ELSE 0 END AS brk FROM w),
parts AS (SELECT *, (sum(brk) OVER (PARTITION BY document_id, page, native ORDER BY line_no))::BIGINT AS part FROM f)"""


@query(f"WITH {PARTS_SQL} SELECT document_id, page::BIGINT AS page, native::BIGINT AS native, line_no, part FROM parts")
def line_sessionize(spark, d):
    """A5, C1."""
    return segment.group_lines(fx.geometry_lines(spark, d)).select("document_id", *long("page", "native", "line_no", "part"))


BLOCKS_SQL = f"""{PARTS_SQL}, bl AS (SELECT document_id, page, native, part, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY line_no) AS raw, max(dir_y) AS dir FROM parts GROUP BY ALL),
blk AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM bl)"""


@query(f"WITH {BLOCKS_SQL} SELECT document_id, printf('p%04d-b%04d-%d', page, native, part) AS block_id, x0, y0, x1, y1, length(text)::BIGINT AS chars, sha256(text) AS digest, CASE WHEN dir > 0.1 THEN 0.4 ELSE 0.85 END::DOUBLE AS confidence FROM blk")
def block_bbox(spark, d):
    """C2 to C5."""
    b = segment.build_blocks(segment.group_lines(fx.geometry_lines(spark, d)))
    return b.select("document_id", "block_id", "x0", "y0", "x1", "y1", F.length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "confidence")


OCR_SQL = f"{BLOCKS_SQL}, o AS (SELECT document_id, page, sum(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')))::BIGINT AS letters, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, chr(65533), '')))::BIGINT AS broken FROM blk GROUP BY ALL)"


@query(f"WITH {OCR_SQL} SELECT document_id, page::BIGINT AS page, letters, chars, broken, letters < 20 OR broken > greatest(1.0, chars * 0.1) AS requires_ocr FROM o")
def ocr_flags(spark, d):
    """C6."""
    return segment.ocr_flags(segment.build_blocks(segment.group_lines(fx.geometry_lines(spark, d)))).select("document_id", *long("page", "letters", "chars", "broken"), "requires_ocr")


@query(f"""WITH {OCR_SQL}, x AS (SELECT document_id, bool_or(letters < 20 OR broken > greatest(1.0, chars * 0.1)) AS ocr FROM o GROUP BY 1),
ti AS (SELECT document_id, string_agg(text, ' ' ORDER BY page, native, part) AS t FROM blk WHERE native = 0 AND page % 5 = 1 GROUP BY 1)
SELECT doc_id AS document_id, coalesce(nullif(t, ''), source) AS title, CASE WHEN ocr THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM documents LEFT JOIN x ON x.document_id = doc_id LEFT JOIN ti ON ti.document_id = doc_id""")
def document_summary(spark, d):
    """C7, C8."""
    b = segment.build_blocks(segment.group_lines(fx.geometry_lines(spark, d))).withColumn("position", F.col("seq")).withColumn("block_type", F.when((F.col("native") == 0) & (F.col("page") % 5 == 1), "title").otherwise("paragraph"))
    stems = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("stem"))
    return segment.document_summary(b, segment.ocr_flags(b), stems).select("document_id", "title", F.size("warnings").cast("long").alias("n_warnings"))


@query("SELECT doc_id, substr(sha256(text), 1, 20) AS document_id FROM documents")
def content_ids(spark, d):
    """A2."""
    return fx.table(spark, d, "documents").select("doc_id", content_id(F.col("text").cast("binary")).alias("document_id"))


@query(f"WITH {fx.LINES_SQL} SELECT document_id, pos AS line_no, line AS text, length(line)::BIGINT AS chars FROM l WHERE length(trim(line)) > 0 AND pos % 4 <> 3")
def span_lines(spark, d):
    """A3, A4: images go, spans of a line are joined in order."""
    halves = fx.doc_lines(spark, d).select("document_id", F.col("pos").alias("line_no"), F.floor(F.length("line") / 2).cast("int").alias("h"), "line")
    cut = halves.select("document_id", "line_no", F.posexplode(F.array(F.substring("line", F.lit(1), F.col("h")), F.substring("line", F.col("h") + 1, F.length("line")))).alias("span_no", "text"))
    spans = cut.selectExpr("*", "1 AS page", "1 AS native", "CASE WHEN line_no % 4 = 3 THEN 1 ELSE 0 END AS type", "0D AS x0", "0D AS y0", "1D AS x1", "1D AS y1", "0D AS dir_y", "600D AS width", "800D AS height", "10D AS font_size")
    return segment.spans_to_lines(spans).select("document_id", "line_no", "text", F.length("text").cast("long").alias("chars"))


# D: layout

SIDES_SQL = f"""{fx.BOXES_SQL}, sd AS (SELECT *, CASE WHEN y1 < 40 THEN 0 WHEN y0 > 752 THEN 2 ELSE 1 END AS stratum, CASE WHEN x1 <= 309 AND x0 < 291 THEN 'left' WHEN x0 >= 291 THEN 'right' ELSE 'span' END AS side FROM g),
pr AS (SELECT DISTINCT a.document_id, a.page FROM sd a JOIN sd b ON a.document_id = b.document_id AND a.page = b.page AND a.side = 'left' AND b.side = 'right' AND a.stratum = 1 AND b.stratum = 1 AND least(a.y1, b.y1) >= greatest(a.y0, b.y0)),
kd AS (SELECT k.*, pr.page IS NOT NULL AS paired, CASE WHEN n_left >= 2 AND n_right >= 2 AND pr.page IS NOT NULL THEN 'two_column' WHEN pr.page IS NOT NULL THEN 'uncertain' ELSE 'single_column' END AS kind
FROM (SELECT document_id, page, count(*) FILTER (side = 'left' AND stratum = 1) AS n_left, count(*) FILTER (side = 'right' AND stratum = 1) AS n_right FROM sd GROUP BY ALL) k LEFT JOIN pr ON pr.document_id = k.document_id AND pr.page = k.page)"""


@query(f"WITH {SIDES_SQL} SELECT document_id, block_id, stratum::BIGINT AS stratum, side FROM sd")
def column_sides(spark, d):
    """D1, D2."""
    return layout.column_sides(fx.boxes(spark, d)).select("document_id", "block_id", *long("stratum"), "side")


@query(f"WITH {SIDES_SQL} SELECT document_id, page::BIGINT AS page FROM pr")
def column_pair_exists(spark, d):
    """D3: a theta semi-join within the page."""
    return layout.paired_pages(layout.column_sides(fx.boxes(spark, d))).select("document_id", *long("page"))


@query(f"WITH {SIDES_SQL} SELECT document_id, page::BIGINT AS page, n_left, n_right, paired, kind FROM kd")
def layout_kind(spark, d):
    """D4."""
    return layout.layout_kinds(layout.column_sides(fx.boxes(spark, d))).select("document_id", *long("page"), "n_left", "n_right", "paired", "kind")


def mode_sql(name: str, source: str, key: str) -> str:
    return f"{name} AS (SELECT {key}, font_size AS body FROM (SELECT {key}, font_size, row_number() OVER (PARTITION BY {key} ORDER BY sum(length(text)) DESC, min(page * 100000 + seq)) AS rn FROM {source} GROUP BY {key}, font_size) WHERE rn = 1)"


@query(f"WITH {fx.BOXES_SQL}, {mode_sql('m', 'g', 'document_id, page')} SELECT document_id, page::BIGINT AS page, body FROM m")
def font_mode(spark, d):
    """Of equal weights the first seen wins."""
    return layout.body_fonts(fx.boxes(spark, d), "document_id", "page").select("document_id", *long("page"), "body")


@query(f"WITH {fx.BOXES_SQL}, {mode_sql('m', 'g', 'document_id')} SELECT document_id, body FROM m")
def document_font_mode(spark, d):
    """E3."""
    return layout.body_fonts(fx.boxes(spark, d), "document_id")


SEPARATED_SQL = f"""{SIDES_SQL}, {mode_sql('mf', "(SELECT * FROM sd WHERE stratum = 1)", 'document_id, page')},
j AS (SELECT sd.*, kd.kind, coalesce(mf.body, 10.0) AS body, min(y0) FILTER (side = 'right' AND stratum = 1) OVER (PARTITION BY sd.document_id, sd.page) AS rt, max(y1) FILTER (side = 'right' AND stratum = 1) OVER (PARTITION BY sd.document_id, sd.page) AS rb
FROM sd JOIN kd ON kd.document_id = sd.document_id AND kd.page = sd.page LEFT JOIN mf ON mf.document_id = sd.document_id AND mf.page = sd.page),
sp AS (SELECT * REPLACE (CASE WHEN stratum = 1 AND kind = 'two_column' AND side = 'left' AND font_size >= body * 1.12 AND length(text) < 120 AND (y1 < rt OR y0 > rb) THEN 'span' ELSE side END AS side) FROM j),
ov AS (SELECT a.document_id, a.page, a.seq AS s_seq, b.seq AS c_seq FROM sp a JOIN sp b ON a.document_id = b.document_id AND a.page = b.page AND a.stratum = 1 AND b.stratum = 1 AND a.kind = 'two_column' AND a.side = 'span' AND b.side <> 'span' AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 3),
tm AS (SELECT document_id, page, s_seq AS seq, 1 AS times FROM ov GROUP BY ALL UNION ALL SELECT document_id, page, c_seq, count(*) FROM ov GROUP BY 1, 2, 3)"""


@query(f"WITH {SEPARATED_SQL} SELECT document_id, block_id, side FROM sp")
def separators(spark, d):
    """D6."""
    sided = layout.column_sides(fx.boxes(spark, d))
    return layout.with_separators(sided, layout.layout_kinds(sided)).select("document_id", "block_id", "side")


@query(f"WITH {SEPARATED_SQL} SELECT document_id, page::BIGINT AS page, seq, times::BIGINT AS times FROM tm")
def span_overlap(spark, d):
    """A range join within the page, one warning for each pair on the column block."""
    sided = layout.column_sides(fx.boxes(spark, d))
    return layout.span_overlaps(layout.with_separators(sided, layout.layout_kinds(sided))).select("document_id", *long("page", "seq", "times"))


ORDER_SQL = f"""{SEPARATED_SQL}, q AS (SELECT sp.*, coalesce(tm.times, 0) AS times, stratum = 1 AND kind = 'two_column' AS two, stratum = 1 AND kind = 'two_column' AND side = 'span' AS sn FROM sp LEFT JOIN tm ON tm.document_id = sp.document_id AND tm.page = sp.page AND tm.seq = sp.seq),
bd AS (SELECT *, CASE WHEN sn THEN row_number() OVER (PARTITION BY document_id, page, stratum, sn ORDER BY y0, seq) - 1 WHEN two THEN sum(CASE WHEN sn THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page, stratum ORDER BY y0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS band,
max(times) OVER (PARTITION BY document_id, page) AS worst FROM q),
rd AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY stratum, band, sn, two AND NOT sn AND side = 'right', y0, CASE WHEN stratum = 1 THEN x0 ELSE 0 END, seq) - 1 AS position,
CASE WHEN kind = 'two_column' AND worst > 0 THEN 'uncertain' ELSE kind END AS layout, kind = 'uncertain' AND stratum = 1 AS few FROM bd)"""


@query(f"WITH {ORDER_SQL} SELECT document_id, page::BIGINT AS page, block_id, position, layout, least(0.85, CASE WHEN few THEN 0.55 WHEN times > 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS confidence, CASE WHEN few THEN 1 ELSE times END::BIGINT AS n_warnings FROM rd")
def reading_order(spark, d):
    """D7 and what it needs, in closed form."""
    return layout.reading_order(fx.boxes(spark, d)).select("document_id", *long("page"), "block_id", "position", "layout", "confidence", F.size("warnings").cast("long").alias("n_warnings"))


@query(f"WITH {ORDER_SQL} SELECT document_id, page::BIGINT AS page, any_value(layout) AS layout, CASE WHEN any_value(layout) = 'uncertain' THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM rd GROUP BY document_id, page")
def page_warnings(spark, d):
    """D9."""
    return layout.page_warnings(layout.reading_order(fx.boxes(spark, d))).select("document_id", *long("page"), "layout", F.size("warnings").cast("long").alias("n_warnings"))


# E: classification

TYPES_SQL = f"""{fx.BOXES_SQL}, {mode_sql('m', 'g', 'document_id')}, ty AS (SELECT g.*, CASE WHEN regexp_full_match(st, '\\d+') AND y0 > 720 THEN 'footer' WHEN regexp_matches(st, '(?i)^(?:Fig(?:ure)?\\.?\\s*\\d+|Table\\s+(?:\\d+|[IVXLCDM]+))\\b') THEN 'caption'
WHEN length(st) < 120 AND regexp_matches(st, '(?i)^(?:\\d+(?:\\.\\d+)*\\.?\\s+)?(?:abstract|introduction|background|related work|methods?|methodology|experiments?|results?|discussion|conclusions?|references|bibliography|acknowledg(?:e)?ments?|appendix)(?:\\s.*)?$') THEN 'section_title'
WHEN page = 1 AND font_size >= body * 1.4 AND y0 < 240 THEN 'title' WHEN length(st) < 120 AND font_size >= body * 1.12 THEN 'section_title' WHEN length(st) < 120 AND regexp_matches(st, '^(?:\\d+(?:\\.\\d+)*\\.?|[IVX]+\\.)\\s+[A-Z]') THEN 'section_title'
WHEN starts_with(st, '$$') OR starts_with(st, '\\[') OR (contains(st, '=') AND length(st) < 120 AND len(string_split_regex(st, '\\s+')) < 14) THEN 'equation' ELSE 'paragraph' END AS block_type
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS st FROM g) g JOIN m ON m.document_id = g.document_id)"""


@query(f"WITH {TYPES_SQL} SELECT document_id, block_id, block_type, CASE WHEN block_type = 'equation' THEN 0.65 ELSE 0.85 END::DOUBLE AS confidence FROM ty")
def block_types(spark, d):
    """E1, E2."""
    return classify.with_types(fx.boxes(spark, d)).select("document_id", "block_id", "block_type", "confidence")


MARGINS_SQL = f"{fx.BOXES_SQL}, mg AS (SELECT document_id, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\d+', '#', 'g') AS signature, count(DISTINCT page) AS pages FROM g WHERE y1 < 56 OR y0 > 744 GROUP BY ALL HAVING count(DISTINCT page) >= 2)"


@query(f"WITH {MARGINS_SQL} SELECT * FROM mg")
def margin_repeats(spark, d):
    """Distinct pages, not occurrences."""
    return classify.repeated_margins(fx.boxes(spark, d))


FILL_SQL = f"{fx.TYPED_SQL}, fl AS (SELECT *, coalesce(last_value(CASE WHEN block_type = 'section_title' THEN CASE WHEN pos % 2 = 1 THEN concat('References ', pos) ELSE text END END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS sec FROM t)"


def filled(spark, d) -> DataFrame:
    t = fx.typed_blocks(spark, d).drop("section")
    return classify.with_sections(t.withColumn("text", F.expr("CASE WHEN block_type = 'section_title' AND pos % 2 = 1 THEN concat('References ', pos) ELSE text END")))


@query(f"WITH {FILL_SQL} SELECT document_id, pos, sha256(sec) AS section_digest FROM fl")
def section_fill(spark, d):
    """E5: forward fill."""
    return filled(spark, d).select("document_id", "pos", F.sha2(F.col("section").cast("binary"), 256).alias("section_digest"))


@query(f"WITH {FILL_SQL} SELECT document_id, pos, CASE WHEN regexp_matches(sec, '(?i)\\b(references|bibliography)\\b') AND block_type NOT IN ('section_title', 'header', 'footer') THEN 'reference' ELSE block_type END AS block_type FROM fl")
def reference_state(spark, d):
    """A function of the filled section, no state."""
    return filled(spark, d).select("document_id", "pos", "block_type")


# H: context, cache, translation, reuse

NEIGHBOURS_SQL = f"""{fx.TYPED_SQL}, nb AS (SELECT *, CASE WHEN block_type IN ('header', 'footer', 'reference') THEN '' ELSE coalesce(last_value(CASE WHEN block_type = 'paragraph' THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS previous,
CASE WHEN block_type IN ('header', 'footer', 'reference') THEN '' ELSE coalesce(first_value(CASE WHEN block_type = 'paragraph' THEN text END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS next FROM t WINDOW w AS (PARTITION BY document_id, section ORDER BY page, position))"""


@query(f"WITH {NEIGHBOURS_SQL} SELECT document_id, pos, sha256(previous) AS previous, sha256(next) AS next FROM nb")
def neighbor_context(spark, d):
    """H1: the nearest paragraph of the same section on either side."""
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(c)
    return context.with_neighbours(fx.typed_blocks(spark, d)).select("document_id", "pos", digest("previous"), digest("next"))


ABSTRACT_SQL = "ab AS (SELECT document_id, string_agg(text, chr(10) ORDER BY page, position) AS abstract FROM t WHERE contains(lower(section), 'abstract') AND block_type = 'paragraph' GROUP BY 1)"


@query(f"WITH {fx.TYPED_SQL}, {ABSTRACT_SQL} SELECT document_id, abstract FROM ab")
def abstract_join(spark, d):
    """H2."""
    return context.abstracts(fx.typed_blocks(spark, d))


@query(f"""WITH {NEIGHBOURS_SQL}, a1 AS (SELECT *, least(length(section), 300 // 4) AS n1 FROM nb), a2 AS (SELECT *, least(2, (300 - n1) // 3) AS n2 FROM a1), a3 AS (SELECT *, least(length(previous), (300 - n1 - n2) // 2) AS n3 FROM a2), a4 AS (SELECT *, least(length(next), 300 - n1 - n2 - n3) AS n4 FROM a3)
SELECT document_id, pos, n1::BIGINT AS section_chars, n2::BIGINT AS terminology_chars, CASE WHEN n3 = 0 THEN '' ELSE right(previous, n3) END AS previous, left(next, n4) AS next FROM a4""")
def context_budget(spark, d):
    """H3."""
    rows = context.bounded(context.with_neighbours(fx.typed_blocks(spark, d)).withColumn("terminology", F.lit("{}")), 300)
    return rows.select("document_id", "pos", F.length("section").cast("long").alias("section_chars"), F.length("terminology").cast("long").alias("terminology_chars"), "previous", "next")


@query("""SELECT o_orderkey, sha256('{"context":{"abstract":"","next":"n' || o_custkey || '","previous":"p","section":"' || o_orderstatus || '","terminology":{"a":"b","c":"' || o_orderpriority || '"}},"identity":"id","prompt":"translation-v1","schema":1,"target_language":"zh","text":"t' || o_orderkey || '"}') AS key FROM orders""")
def cache_key(spark, d):
    """H4."""
    terms = context.sorted_json(F.create_map(F.lit("c"), "o_orderpriority", F.lit("a"), F.lit("b")))
    key = context.cache_key(F.lit("id"), F.lit("zh"), F.concat(F.lit("t"), "o_orderkey"), F.col("o_orderstatus"), F.lit("p"), F.concat(F.lit("n"), "o_custkey"), F.lit(""), terms)
    return fx.table(spark, d, "orders").select("o_orderkey", key.alias("key"))


@query("SELECT s_suppkey, 'chat-completions-v1:' || substr(sha256('http://host/' || s_suppkey), 1, 16) || ':m' || s_nationkey AS identity FROM supplier")
def provider_identity(spark, d):
    """H5."""
    return fx.table(spark, d, "supplier").select("s_suppkey", context.provider_identity(F.concat(F.lit("http://host/"), "s_suppkey", F.lit("/")), F.concat(F.lit("m"), "s_nationkey")).alias("identity"))


CACHE_SQL = "c AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS v, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE 'r' || o_custkey END AS raw FROM orders WHERE o_orderkey % 3 = 0)"


def cache_rows(spark, d) -> DataFrame:
    return fx.table(spark, d, "orders").filter("o_orderkey % 3 = 0").selectExpr("CAST(o_orderkey AS STRING) AS key", "CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS schema_version", "CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE concat('r', o_custkey) END AS raw_translation")


@query(f"WITH {CACHE_SQL} SELECT o.o_orderkey, c.raw AS cached FROM orders o LEFT JOIN c ON c.key = o.o_orderkey AND c.v = 1 AND trim(c.raw) <> ''")
def cache_lookup(spark, d):
    """Another version or a blank entry is a miss."""
    asked = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"))
    return translate.cache_lookup(asked, cache_rows(spark, d)).select("o_orderkey", "cached")


@query("SELECT o_orderkey, 'r' || o_custkey AS raw_translation, substr(o_orderkey::VARCHAR, 1, 2) AS prefix FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 <> 1")
def cache_admission(spark, d):
    """Passed, called, no warning at all."""
    rows = fx.table(spark, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS key", "concat('r', o_custkey) AS raw", "CASE WHEN o_orderkey % 6 = 1 THEN array('w') ELSE CAST(array() AS ARRAY<STRING>) END AS warnings", "'provider' AS origin", "named_struct('passed', o_orderkey % 4 <> 0) AS check")
    return translate.admitted(rows).select(F.col("key").cast("long").alias("o_orderkey"), "raw_translation", F.substring("key", 1, 2).alias("prefix"))


@query(f"WITH {fx.TYPED_SQL} SELECT document_id, block_id FROM t WHERE pos % 4 <> 1 AND pos % 6 <> 2")
def resume_candidates(spark, d):
    """H8: the same block with the same text."""
    now = fx.typed_blocks(spark, d).select("document_id", "block_id", "text", "pos")
    before = now.filter("pos % 6 <> 2").withColumn("text", F.expr("CASE WHEN pos % 4 = 1 THEN concat(text, '!') ELSE text END")).drop("pos")
    return translate.resume_candidates(now.drop("pos"), before).select("document_id", "block_id")


@query(f"WITH {fx.SENTENCES_SQL} SELECT c, CASE WHEN c % 4 = 0 AND c <> 4 THEN count(*) ELSE 0 END AS resumable FROM s GROUP BY c")
def resume_predicate(spark, d):
    """H9: translated, still restoring to what was stored."""
    rows = damaged(spark, d).withColumn("r", tokens.restore("raw", "items"))
    old = rows.select("c", F.when(F.col("c") == 4, "failed").otherwise("translated").alias("old_translation_status"), F.col("raw").alias("old_raw_translation"), F.col("items").alias("old_items"), F.col("r.text").alias("old_translation"), F.struct(F.lit(True).alias("passed")).alias("old_check"))
    good = translate.resumable(old, "failed").groupBy("c").agg(F.count("*").alias("k"))
    return old.select("c").distinct().join(good, "c", "left").select("c", F.coalesce("k", F.lit(0)).alias("resumable"))


@query(f"WITH {fx.TYPED_SQL} SELECT origin, count(*) AS n FROM (SELECT CASE WHEN block_type IN ('header', 'equation') THEN 'retained' WHEN pos % 3 = 0 THEN 'resume' WHEN pos % 3 = 1 THEN 'cache' ELSE 'provider' END AS origin FROM t) GROUP BY 1")
def source_precedence(spark, d):
    """H6, H11."""
    t = fx.typed_blocks(spark, d)
    return t.groupBy(translate.precedence(F.col("block_type"), F.col("pos") % 3 == 0, F.col("pos") % 3 == 1).alias("origin")).agg(F.count("*").alias("n"))


OUTCOMES_SQL = f"""{fx.TYPED_SQL}, oc AS (SELECT document_id, pos, CASE WHEN block_type IN ('header', 'equation') THEN 'retained' WHEN pos % 3 = 0 THEN 'resume' WHEN pos % 3 = 1 THEN 'cache' ELSE 'provider' END AS origin, pos % 7 = 5 AND document_id % 4 = 1 AS fatal FROM t),
la AS (SELECT *, origin NOT IN ('retained', 'resume') AND coalesce(max(CASE WHEN fatal AND origin NOT IN ('retained', 'resume') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS skipped FROM oc)"""


def outcomes(spark, d) -> DataFrame:
    t = fx.typed_blocks(spark, d)
    return translate.fatal_latch(t.select("document_id", F.col("pos").alias("seq"), translate.precedence(F.col("block_type"), F.col("pos") % 3 == 0, F.col("pos") % 3 == 1).alias("origin"), ((F.col("pos") % 7 == 5) & (F.col("document_id") % 4 == 1)).alias("fatal")))


@query(f"WITH {OUTCOMES_SQL} SELECT document_id, pos AS seq, skipped FROM la")
def fatal_latch(spark, d):
    """H15."""
    return outcomes(spark, d).select("document_id", "seq", "skipped")


def results(spark, d) -> DataFrame:
    bad = F.col("skipped") | (F.col("fatal") & ~F.col("origin").isin("retained", "resume"))
    rows = outcomes(spark, d).withColumn("called", (F.col("origin") == "provider") & ~F.col("skipped"))
    return rows.withColumn("status", F.when(bad, "failed").when(F.col("origin") == "retained", "retained").otherwise("translated")).withColumn("passed", F.when(F.col("origin") != "retained", ~bad & (F.col("seq") % 10 != 4)))


RESULTS_SQL = f"{OUTCOMES_SQL}, rs AS (SELECT *, skipped OR (fatal AND origin NOT IN ('retained', 'resume')) AS bad FROM la)"


@query(f"WITH {RESULTS_SQL} SELECT document_id, count(*) FILTER (origin = 'provider' AND NOT skipped) AS provider_calls, count(*) FILTER (origin = 'cache') AS cache_hits, count(*) FILTER (origin = 'resume') AS resumed_blocks, count(*) FILTER (origin = 'retained') AS retained_blocks, count(*) FILTER (bad) AS failed_blocks FROM rs GROUP BY 1")
def processing_stats(spark, d):
    """Calls count before they are made."""
    return translate.processing_stats(results(spark, d))


@query(f"WITH {RESULTS_SQL} SELECT doc_id AS document_id, CASE WHEN n IS NULL THEN 'failed' WHEN f OR r OR doc_id % 5 = 2 THEN 'partial' ELSE 'completed' END AS status FROM documents LEFT JOIN (SELECT document_id, count(*) AS n, bool_or(bad) AS f, bool_or(origin <> 'retained' AND (bad OR pos % 10 = 4)) AS r FROM rs WHERE document_id % 9 <> 3 GROUP BY 1) x ON x.document_id = doc_id")
def document_status(spark, d):
    """H18."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    pages = docs.selectExpr("document_id", "document_id % 10 = 2 AS requires_ocr", "CASE WHEN document_id % 10 = 7 THEN 'uncertain' ELSE 'two_column' END AS layout")
    return translate.document_status(docs, results(spark, d).filter("document_id % 9 <> 3"), pages)


# B, I: output and explanation

STATUS = "CASE pos % 5 WHEN 0 THEN 'demo' WHEN 1 THEN 'retained' WHEN 2 THEN 'pending' ELSE 'translated' END"


@query(f"WITH {fx.LINES_SQL} SELECT badge, count(*) AS n FROM (SELECT CASE WHEN pos % 5 = 0 THEN 'risk' WHEN pos % 5 IN (1, 2) THEN '' WHEN pos % 3 = 0 AND pos % 4 <> 1 AND pos % 7 <> 2 THEN 'ok' ELSE 'risk' END AS badge FROM l) GROUP BY 1")
def badges(spark, d):
    """B3, B4."""
    l = fx.doc_lines(spark, d)  # noqa: E741
    b = sinks.badge(F.expr(STATUS), F.col("pos") % 3 == 0, F.when(F.col("pos") % 4 == 1, 0.5).otherwise(0.85), F.when(F.col("pos") % 7 == 2, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")))
    return l.groupBy(b.alias("badge")).agg(F.count("*").alias("n"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def html_escaped(spark, d):
    """B5."""
    return fx.table(spark, d, "pages").select("page_id", F.sha2(html_escape(F.col("html")).cast("binary"), 256).alias("digest"))


def escaped_sql(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\'\'', '&#x27;')"


ARTICLE_SQL = f"""{fx.TYPED_SQL}, ar AS (SELECT document_id, page, position, pos % 5 IN (3, 4) AND pos % 3 = 0 AS ok, '<article id="' || block_id || '"><header>' || block_id || ' · ' || block_type || ' · ' || section || ' <b class="' || CASE WHEN pos % 5 = 0 THEN 'risk' WHEN pos % 5 IN (1, 2) THEN '' WHEN pos % 3 = 0 THEN 'ok' ELSE 'risk' END || '">' || {STATUS} || '</b></header><div class="source">' || {escaped_sql('text')} || '</div><div class="translation">' || {escaped_sql('text')} || '</div>'
|| CASE WHEN pos % 3 = 0 THEN '' ELSE '<ul><li>X:  → </li></ul>' END || '<a class="explain" href="?document=' || document_id || '&amp;block=' || block_id || '">Explain</a></article>' AS h FROM t), ap AS (SELECT document_id, page, count(*) AS n, count(*) FILTER (ok) AS good, '<section class="page"><h2>Page ' || page || '</h2>' || string_agg(h, chr(10) ORDER BY position) || '</section>' AS part FROM ar GROUP BY document_id, page)"""


@query(f"""WITH {ARTICLE_SQL} SELECT document_id, sum(n)::BIGINT AS blocks, sum(good)::BIGINT AS verified, sha256('<!doctype html><html><head><meta charset="utf-8"><title>t</title></head><body><h1>t</h1><p>f · completed · ' || sum(good)::BIGINT || ' verified</p>' || string_agg(part, chr(10) ORDER BY page) || '</body></html>') AS digest FROM ap GROUP BY 1""")
def html_export(spark, d):
    """B2: one page for each document, blocks in order."""
    b = fx.typed_blocks(spark, d).withColumns({"translation": F.col("text"), "translation_status": F.expr(STATUS), "confidence": F.lit(0.9), "warnings": F.array().cast("array<string>"), "explanation": F.lit(None).cast("struct<plain_explanation:string,role_in_paper:string>"), "check": verify.as_check(F.when(F.col("pos") % 3 == 0, F.array().cast(verify.NO_ERRORS)).otherwise(F.array(verify.error("X"))))})
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("t").alias("title"), F.lit("f").alias("filename"), F.lit("completed").alias("status"), F.array().cast("array<string>").alias("warnings"))
    return sinks.render_html(b, docs).select("document_id", F.regexp_count("html", F.lit('<article id="b')).cast("long").alias("blocks"), "verified", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


@query(f"WITH {fx.TYPED_SQL} SELECT document_id, count(DISTINCT page) AS pages, count(*) AS blocks, sha256(string_agg(block_id, ',' ORDER BY page, position)) AS digest FROM t GROUP BY 1")
def nested_documents(spark, d):
    """B1."""
    t = fx.typed_blocks(spark, d)
    tree = sinks.nested(t.drop("pos"), t.select("document_id", "page").distinct(), t.select("document_id").distinct())
    ids = F.flatten(F.transform("pages", lambda p: F.transform(p["blocks"], lambda b: b["block_id"])))
    return tree.select("document_id", F.size("pages").cast("long").alias("pages"), F.size(ids).cast("long").alias("blocks"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("digest"))


@query(f"WITH {fx.LINES_SQL}, w AS (SELECT document_id, count(*) AS n, list(pos ORDER BY pos)[1:10] AS f FROM l GROUP BY 1) SELECT document_id, least(n, 10) AS kept, list_sum(f)::BIGINT AS total FROM w")
def warning_topn(spark, d):
    """The first ten warnings."""
    w = fx.doc_lines(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list("pos")).alias("w")).withColumn("f", explain.top_warnings(F.col("w")))
    return w.select("document_id", F.size("f").cast("long").alias("kept"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"WITH {fx.TYPED_SQL}, {ABSTRACT_SQL} SELECT t.document_id, block_id, length(t.text) * 2 > 800 AS too_long, least(length(coalesce(abstract, '')), 6000)::BIGINT AS most_abstract FROM t LEFT JOIN ab ON ab.document_id = t.document_id")
def explain_requests(spark, d):
    """I1, I2."""
    t = fx.typed_blocks(spark, d).withColumns({"translation": F.col("text"), "warnings": F.array(F.lit("w"))})
    whole = context.with_context(fx.typed_blocks(spark, d)).select("document_id", "block_id", F.least(F.length("abstract"), F.lit(6000)).cast("long").alias("most_abstract"))
    return explain.requests(t, most_chars=400).select("document_id", "block_id", "too_long").join(whole, ["document_id", "block_id"])


@query("SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS valid FROM orders")
def explain_payloads(spark, d):
    """One fence is taken off, another shape is refused."""
    good = '{"plain_explanation": "a", "role_in_paper": "b", "key_terms": [{"term": "t", "explanation": "e"}]}'
    raw = F.when(F.col("o_orderkey") % 4 == 0, good).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("```json\n" + good + "\n```"))).when(F.col("o_orderkey") % 4 == 2, '{"plain_explanation": "", "role_in_paper": "b"}').otherwise("not json")
    return explain.parsed(fx.table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))).select("o_orderkey", F.col("explanation").isNotNull().alias("valid"))


# J: evaluation

VERDICT = "CASE pos % 6 WHEN 0 THEN 'not_reviewed' WHEN 1 THEN 'pass' WHEN 2 THEN 'minor_error' WHEN 3 THEN 'major_error' WHEN 4 THEN 'unusable' ELSE 'pass' END"


def labels(spark, d) -> DataFrame:
    """Block labels that are wrong in known places."""
    t = fx.typed_blocks(spark, d)
    return t.select(
        "document_id", "block_id", "pos", F.sha2(F.expr("CASE WHEN document_id % 20 = 3 AND pos = 1 THEN 'old' ELSE text END").cast("binary"), 256).alias("source_text_hash"),
        F.expr("CASE WHEN pos % 8 = 7 THEN 'caption' ELSE block_type END").alias("expected_block_type"), (F.col("pos") % 2 == 0).alias("block_type_reviewed"), F.lit(False).alias("protection_reviewed"), F.expr(VERDICT).alias("verdict"), F.expr("CASE WHEN pos % 6 = 3 THEN array('omission', 'number') WHEN pos % 6 = 4 THEN array('omission') ELSE CAST(array() AS ARRAY<STRING>) END").alias("error_tags"),
        F.sha2(F.expr("CASE WHEN document_id % 20 = 5 AND pos = 2 THEN 'old' ELSE text END").cast("binary"), 256).alias("translation_hash"), F.array().cast("array<struct<kind:string,value:string,start:int,end:int>>").alias("expected_items"),
    )


def labelled(spark, d) -> DataFrame:
    return fx.typed_blocks(spark, d).withColumn("translation", F.col("text"))


INVALID_SQL = "bad AS (SELECT document_id, block_id, 'the source text is another' AS error FROM t WHERE document_id % 20 = 3 AND pos = 1 UNION ALL SELECT document_id, block_id, CASE WHEN text = '' THEN '' ELSE 'the translation is another than the one reviewed' END FROM t WHERE document_id % 20 = 5 AND pos = 2)"


@query(f"WITH {fx.TYPED_SQL}, {INVALID_SQL} SELECT document_id, block_id, CASE WHEN error = '' THEN 'the translation is another than the one reviewed' ELSE error END AS error FROM bad")
def stale_labels(spark, d):
    """J1, J4."""
    return evaluate.label_errors(labelled(spark, d), labels(spark, d))


def page_labels(spark, d) -> DataFrame:
    """Expected orders: reversed on every fifth page, rotated by one block on every third, else as predicted."""
    t = fx.typed_blocks(spark, d).groupBy("document_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "block_id"))), lambda x: x["block_id"]).alias("o"))
    order = F.when(F.col("page") % 5 == 0, F.reverse("o")).when(F.col("page") % 3 == 0, F.concat(F.slice("o", F.lit(2), F.size("o")), F.slice("o", 1, 1))).otherwise(F.col("o"))
    issues = F.when((F.col("document_id") + F.col("page")) % 4 == 0, F.array(F.lit("merged"), F.lit("split"))).when((F.col("document_id") + F.col("page")) % 4 == 1, F.array(F.lit("merged"))).otherwise(F.array().cast("array<string>"))
    return t.select("document_id", "page", order.alias("expected_order"), (F.col("page") % 2 == 1).alias("reading_order_reviewed"), (F.col("document_id") % 3 != 0).alias("segmentation_reviewed"), issues.alias("segmentation_issues"))


PAGES_SQL = f"{fx.TYPED_SQL}, pg AS (SELECT document_id, page, count(*) AS n FROM t GROUP BY ALL)"


@query(f"WITH {PAGES_SQL}, x AS (SELECT count(*) AS pages, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(CASE WHEN page % 5 = 0 THEN 0 WHEN page % 3 = 0 THEN (n - 1) * (n - 2) // 2 ELSE n * (n - 1) // 2 END)::BIGINT AS correct FROM pg WHERE page % 2 = 1) SELECT *, correct / pairs AS accuracy FROM x")
def order_pair_accuracy(spark, d):
    """J7."""
    return evaluate.order_pairs(fx.typed_blocks(spark, d), page_labels(spark, d)).select(*long("pages", "pairs", "correct"), "accuracy")


@query(f"WITH {PAGES_SQL}, x AS (SELECT count(*) AS reviewed, count(*) FILTER ((document_id + page) % 4 IN (0, 1)) AS with_issues FROM pg WHERE document_id % 3 <> 0) SELECT *, with_issues / reviewed AS rate FROM x")
def segmentation_issues(spark, d):
    """J8."""
    return evaluate.segmentation(page_labels(spark, d))


@query(f"WITH {PAGES_SQL}, y AS (SELECT * FROM pg WHERE document_id % 3 <> 0) SELECT 'merged' AS issue, count(*) AS n FROM y WHERE (document_id + page) % 4 IN (0, 1) UNION ALL SELECT 'split', count(*) FROM y WHERE (document_id + page) % 4 = 0")
def issue_histogram(spark, d):
    """J8."""
    return evaluate.issue_histogram(page_labels(spark, d))


@query(f"WITH {PAGES_SQL} SELECT document_id, page::BIGINT AS page, 'a block stands twice in the expected order' AS error FROM pg WHERE page % 4 = 2 UNION ALL SELECT document_id, page, 'the expected order has other blocks than the page' FROM pg WHERE page % 4 = 3")
def page_label_errors(spark, d):
    """Orders with a block twice, and orders without one."""
    p = page_labels(spark, d)
    order = F.when(F.col("page") % 4 == 2, F.concat("expected_order", F.slice("expected_order", 1, 1))).when(F.col("page") % 4 == 3, F.array_append(F.slice("expected_order", F.lit(2), F.size("expected_order")), F.lit("gone"))).otherwise(F.col("expected_order"))
    return evaluate.page_errors(fx.typed_blocks(spark, d), p.withColumn("expected_order", order)).select("document_id", *long("page"), "error")


@query(f"WITH {fx.TYPED_SQL}, x AS (SELECT count(*) AS reviewed, count(*) AS correct FROM t WHERE pos % 2 = 0) SELECT *, correct / reviewed AS accuracy FROM x")
def type_accuracy_even(spark, d):
    """J9, on labels that are all right."""
    return evaluate.type_accuracy(fx.typed_blocks(spark, d), labels(spark, d))


@query(f"WITH {fx.TYPED_SQL}, x AS (SELECT count(*) AS reviewed, count(*) FILTER (pos % 8 <> 7) AS correct FROM t WHERE pos % 2 = 1 AND document_id % 20 NOT IN (3, 5)) SELECT *, correct / reviewed AS accuracy FROM x")
def type_accuracy(spark, d):
    """Documents with errors are left out whole."""
    marked = labels(spark, d).withColumn("block_type_reviewed", F.col("pos") % 2 == 1)
    extra = fx.typed_blocks(spark, d).filter("document_id % 20 in (3, 5)").select("document_id").distinct()
    return evaluate.type_accuracy(fx.typed_blocks(spark, d), evaluate.valid_only(marked, evaluate.label_errors(labelled(spark, d), labels(spark, d)), extra))


@query(f"WITH {fx.SENTENCES_SQL}, x AS (SELECT 5 * count(*) AS predicted, (5 * count(*) FILTER (o % 4 <> 0) + 4 * count(*) FILTER (o % 4 = 0)) AS expected, (5 * count(*) FILTER (o % 4 NOT IN (0, 1)) + 4 * count(*) FILTER (o % 4 IN (0, 1))) AS hits FROM s) SELECT *, hits / predicted AS precision, hits / expected AS recall, 2 * (hits / predicted) * (hits / expected) / (hits / predicted + hits / expected) AS f1 FROM x")
def span_prf(spark, d):
    """Expected spans lack one item in a quarter of the blocks, and have a wrong one in another."""
    s = fx.sentences(spark, d).withColumnRenamed("source", "text").withColumn("document_id", F.col("o")).withColumn("block_id", F.concat_ws("-", "n", "part", "k", "q", "d")).withColumn("found", tokens.scan("text"))
    items = F.when(F.col("o") % 4 == 0, F.slice("found", 1, 4)).when(F.col("o") % 4 == 1, F.transform("found", lambda t, i: F.when(i == 0, F.struct(t["kind"].alias("kind"), t["value"].alias("value"), (t["start"] + 1).alias("start"), t["end"].alias("end"))).otherwise(t))).otherwise(F.col("found"))
    return evaluate.span_sums(s.select("found", items.alias("expected_items"))).select(*long("predicted", "expected", "hits"), "precision", "recall", "f1")


@query(f"WITH {fx.TYPED_SQL}, x AS (SELECT pos % 6 AS v FROM t WHERE pos % 6 <> 0) SELECT count(*) AS reviewed, count(*) FILTER (v IN (1, 5)) / count(*) AS passed_rate, count(*) FILTER (v IN (1, 2, 5)) / count(*) AS acceptable_rate, count(*) FILTER (v IN (3, 4)) / count(*) AS major_rate FROM x")
def verdict_rates(spark, d):
    """J11, J12."""
    return evaluate.verdict_rates(labels(spark, d))


@query(f"WITH {fx.TYPED_SQL} SELECT 'omission' AS tag, count(*) AS n FROM t WHERE pos % 6 IN (3, 4) UNION ALL SELECT 'number', count(*) FROM t WHERE pos % 6 = 3")
def tag_histogram(spark, d):
    """J11."""
    return evaluate.tag_histogram(labels(spark, d))


@query("SELECT doc_id AS document_id FROM documents WHERE doc_id % 3 <> 0")
def new_documents(spark, d):
    """What the manifest doesn't have."""
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    return evaluate.new_documents(docs, docs.filter("document_id % 3 = 0"))


FINGERPRINT_SQL = "fp AS (SELECT document_id, sha256(string_agg(length(block_id) || ':' || block_id || length(page::VARCHAR) || ':' || page || length(text) || ':' || text, chr(10) ORDER BY block_id)) AS fingerprint FROM t GROUP BY 1)"


@query(f"WITH {fx.TYPED_SQL}, {FINGERPRINT_SQL} SELECT * FROM fp")
def fingerprints(spark, d):
    """Of ids, pages and texts."""
    return evaluate.fingerprint(fx.typed_blocks(spark, d))


def annotations(spark, d) -> DataFrame:
    """Of every document and of one that isn't there for each of the first ids; every seventh with an old fingerprint, every second complete."""
    own = evaluate.fingerprint(fx.typed_blocks(spark, d)).select("document_id", F.expr("CASE WHEN document_id % 7 = 2 THEN 'old' ELSE fingerprint END").alias("source_fingerprint"), F.expr("CASE WHEN document_id % 2 = 0 THEN 'complete' ELSE 'draft' END").alias("status"))
    return own.union(own.filter("document_id < 3").select(-F.col("document_id") - 1, "source_fingerprint", "status"))


@query(f"WITH {fx.TYPED_SQL}, d AS (SELECT DISTINCT document_id FROM t) SELECT document_id, 'segmentation or text is another than the one annotated' AS error FROM d WHERE document_id % 7 = 2 UNION ALL SELECT -document_id - 1, 'no document of this id' FROM d WHERE document_id < 3")
def document_errors(spark, d):
    """Ids and fingerprints."""
    return evaluate.document_errors(fx.typed_blocks(spark, d), annotations(spark, d))


BAD_DOCS_SQL = f"""{INVALID_SQL}, dd AS (SELECT DISTINCT document_id FROM t), er AS (SELECT document_id, 'segmentation or text is another than the one annotated' AS line FROM dd WHERE document_id % 7 = 2 UNION ALL SELECT -document_id - 1, 'no document of this id' FROM dd WHERE document_id < 3
UNION ALL SELECT document_id, block_id || ': ' || CASE WHEN error = '' THEN 'the translation is another than the one reviewed' ELSE error END FROM bad), ok AS (SELECT document_id FROM dd WHERE document_id NOT IN (SELECT document_id FROM er))"""


@query(f"""WITH {fx.TYPED_SQL}, {BAD_DOCS_SQL} SELECT document_id, CASE WHEN contains(line, ': ') THEN split_part(line, ': ', 1) ELSE '' END AS place, CASE WHEN contains(line, ': ') THEN split_part(line, ': ', 2) ELSE line END AS error FROM er""")
def workspace_errors(spark, d):
    """All labels against all predictions."""
    return evaluate.workspace_errors(labelled(spark, d), annotations(spark, d), page_labels(spark, d), labels(spark, d))


@query(f"""WITH {fx.TYPED_SQL}, {BAD_DOCS_SQL}, g AS (SELECT * FROM t WHERE document_id IN (SELECT document_id FROM ok)), pg AS (SELECT document_id, page, count(*) AS n FROM g GROUP BY ALL), od AS (SELECT * FROM pg WHERE page % 2 = 1), sg AS (SELECT *, (document_id + page) % 4 AS k FROM pg WHERE document_id % 3 <> 0),
op AS (SELECT count(*) AS pages, sum(n * (n - 1) // 2) AS pairs, sum(CASE WHEN page % 5 = 0 THEN 0 WHEN page % 3 = 0 THEN (n - 1) * (n - 2) // 2 ELSE n * (n - 1) // 2 END) AS correct FROM od), bt AS (SELECT count(*) AS n, count(*) FILTER (pos % 8 <> 7) AS c FROM g WHERE pos % 2 = 0), vd AS (SELECT pos % 6 AS v FROM g WHERE pos % 6 <> 0), vs AS (SELECT count(*) AS n, count(*) FILTER (v IN (1, 5)) AS p, count(*) FILTER (v IN (1, 2, 5)) AS a, count(*) FILTER (v IN (3, 4)) AS m FROM vd)
SELECT (SELECT count(*) FROM dd) + (SELECT count(*) FROM dd WHERE document_id < 3) AS documents, (SELECT count(*) FROM ok WHERE document_id % 2 = 0) AS completed_documents, op.pages AS pages_reviewed, op.correct / op.pairs AS reading_order_pair_accuracy, (SELECT count(*) FROM sg) AS segmentation_pages_reviewed, (SELECT count(*) FILTER (k IN (0, 1)) / count(*) FROM sg) AS segmentation_issue_page_rate, (SELECT count(*) FILTER (k IN (0, 1)) FROM sg) AS merged, (SELECT count(*) FILTER (k = 0) FROM sg) AS split,
bt.n AS block_types_reviewed, bt.c / bt.n AS block_type_accuracy, vs.n AS translations_reviewed, vs.p / vs.n AS translation_pass_rate, vs.a / vs.n AS translation_acceptable_rate, vs.m / vs.n AS translation_major_error_rate, (SELECT count(*) FROM vd WHERE v IN (3, 4)) AS omission, (SELECT count(*) FROM vd WHERE v = 3) AS number,
(SELECT sha256(string_agg(x, chr(10) ORDER BY x)) FROM (SELECT document_id || ': ' || line AS x FROM er)) AS warnings FROM op, bt, vs""")
def evaluation_summary(spark, d):
    """J6 to J12 in one row; documents with an error are left out whole."""
    s = evaluate.summary("fixture", labelled(spark, d), annotations(spark, d), page_labels(spark, d), labels(spark, d))
    held = lambda m, k: F.element_at(m, k).alias(k)
    return s.select("documents", "completed_documents", *long("pages_reviewed"), "reading_order_pair_accuracy", "segmentation_pages_reviewed", "segmentation_issue_page_rate", held("segmentation_issues", "merged"), held("segmentation_issues", "split"), "block_types_reviewed", "block_type_accuracy",
        "translations_reviewed", "translation_pass_rate", "translation_acceptable_rate", "translation_major_error_rate", held("translation_error_tags", "omission"), held("translation_error_tags", "number"), F.sha2(F.array_join("warnings", "\n").cast("binary"), 256).alias("warnings"))


MARGIN_TYPES_SQL = f"""{TYPES_SQL}, {MARGINS_SQL.removeprefix(fx.BOXES_SQL + ', ')}, mt AS (SELECT ty.*, coalesce(CASE WHEN mg.pages IS NOT NULL THEN CASE WHEN y1 < 56 THEN 'header' WHEN y0 > 744 THEN 'footer' END END, block_type) AS bt FROM ty LEFT JOIN mg ON mg.document_id = ty.document_id AND mg.signature = regexp_replace(lower(st), '\\d+', '#', 'g')),
fs AS (SELECT *, coalesce(last_value(CASE WHEN bt = 'section_title' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS sec FROM mt)"""


@query(f"WITH {MARGIN_TYPES_SQL} SELECT document_id, block_id, sha256(sec) AS section_digest, CASE WHEN regexp_matches(sec, '(?i)\\b(references|bibliography)\\b') AND bt NOT IN ('section_title', 'header', 'footer') THEN 'reference' ELSE bt END AS block_type FROM fs")
def classified_blocks(spark, d):
    """E1 to E6 in a row: types, margins, sections, references."""
    rows = classify.classify(fx.boxes(spark, d).withColumn("position", F.col("seq")))
    return rows.select("document_id", "block_id", F.sha2(F.col("section").cast("binary"), 256).alias("section_digest"), "block_type")


# Whole runs


def translator(fatal: str, failing: str):
    """A provider that refuses for good in one section, and fails in another."""

    def make():
        from ..operators.provider import ProviderError

        def complete(text: str, user: str) -> str:
            section = json.loads(user)["context"]["section"]
            if section in (fatal, failing):
                raise ProviderError("refused" if section == fatal else "failed", fatal=section == fatal)
            return "→ " + text

        return complete

    return make


OPTIONS = run.Options(model="m", identity="fixture:m", most_chars=10_000_000)


def first_run(spark, d, cache: str | None, work: str) -> run.Translated:
    """The provider fails in section s2."""
    b, p, docs = run_inputs(spark, d)
    return run.translate_blocks(b, p, docs, OPTIONS, translator("", "s2"), work, cache)


def run_inputs(spark, d):
    b = fx.typed_blocks(spark, d).withColumn("warnings", F.array().cast("array<string>"))
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.array().cast("array<string>").alias("warnings"))
    return b, b.select("document_id", "page").distinct().withColumns({"requires_ocr": F.lit(False), "layout": F.lit("single_column")}), docs


RUN_COLUMNS = ("document_id", "status", "provider_calls", "cache_hits", "resumed_blocks", "retained_blocks", "failed_blocks")


@query(f"WITH {fx.TYPED_SQL}, r AS (SELECT document_id, block_type IN ('header', 'equation') AS kept, section = 's2' AS bad FROM t) SELECT document_id, CASE WHEN bool_or(bad AND NOT kept) THEN 'partial' ELSE 'completed' END AS status, count(*) FILTER (NOT kept) AS provider_calls, 0::BIGINT AS cache_hits, 0::BIGINT AS resumed_blocks, count(*) FILTER (kept) AS retained_blocks, count(*) FILTER (bad AND NOT kept) AS failed_blocks FROM r GROUP BY 1")
def translation_run(spark, d):
    """H6, H11, H13, H16 to H18, G9 end to end: a first run, whose provider fails in one section."""
    return first_run(spark, d, None, scratch(spark, "run")).documents.select(*RUN_COLUMNS)


@query(f"WITH {fx.TYPED_SQL}, r AS (SELECT document_id, block_type IN ('header', 'equation') AS kept, section = 's2' AS bad FROM t) SELECT document_id, 'completed' AS status, count(*) FILTER (bad AND NOT kept) AS provider_calls, 0::BIGINT AS cache_hits, count(*) FILTER (NOT bad AND NOT kept) AS resumed_blocks, count(*) FILTER (kept) AS retained_blocks, 0::BIGINT AS failed_blocks FROM r GROUP BY 1")
def resumed_run(spark, d):
    """H7 to H10 end to end: a second run that takes over what is done and calls for the rest."""
    first = scratch(spark, "run")
    before = first_run(spark, d, None, first)
    b, p, docs = run_inputs(spark, d)
    second = run.translate_blocks(b, p, docs, replace(OPTIONS, retry="failed"), translator("", ""), scratch(spark, "run"), None, before)
    delete(spark, first)
    return second.documents.select(*RUN_COLUMNS)


@query(f"""WITH {fx.TYPED_SQL}, r AS (SELECT document_id, pos, block_type IN ('header', 'equation') AS kept, section = 's2' AS bad FROM t),
f AS (SELECT *, coalesce(max(CASE WHEN bad AND NOT kept THEN 1 END) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS behind FROM r)
SELECT document_id, CASE WHEN bool_or((bad OR behind) AND NOT kept) THEN 'partial' ELSE 'completed' END AS status, count(*) FILTER (bad AND NOT behind AND NOT kept) AS provider_calls, count(*) FILTER (NOT bad AND NOT behind AND NOT kept) AS cache_hits, 0::BIGINT AS resumed_blocks, count(*) FILTER (kept) AS retained_blocks, count(*) FILTER ((bad OR behind) AND NOT kept) AS failed_blocks FROM f GROUP BY 1""")
def cached_run(spark, d):
    """H4, H11, H12, H15 end to end: a second run from the cache of the first, whose provider refuses for good; behind that not even the cache is used."""
    cache, first = scratch(spark, "cache"), scratch(spark, "run")
    first_run(spark, d, cache, first)
    # The second run knows of the first by the cache alone.
    delete(spark, first)
    b, p, docs = run_inputs(spark, d)
    second = run.translate_blocks(b, p, docs, OPTIONS, translator("s2", ""), scratch(spark, "run"), cache)
    delete(spark, cache)
    return second.documents.select(*RUN_COLUMNS)


@query("SELECT p_partkey, p_partkey % 3 = 0 AS found FROM part")
def block_lookup(spark, d):
    """A block by its id, or KeyError."""
    parts = fx.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).alias("document_id"), F.concat(F.lit("b"), "p_partkey").alias("block_id"))
    return explain.lookup(parts, parts.select("p_partkey", "block_id", F.lit(0).cast("long").alias("document_id"))).select("p_partkey", "found")


@query(r"""WITH s AS (SELECT p_partkey AS k, p_partkey % 6 AS c FROM part) SELECT kind, count(*) AS n, sum(chars)::BIGINT AS chars FROM (
SELECT 'MATH' AS kind, length(CASE c WHEN 0 THEN '$x_' || k || '$' WHEN 1 THEN '$$a = ' || k || '$$' WHEN 2 THEN '\(y^' || k || '\)' ELSE '\[z - ' || k || '\]' END) AS chars FROM s WHERE c < 4 UNION ALL SELECT 'SYMBOL', length('H' || k) FROM s UNION ALL SELECT 'SYMBOL', 3 FROM s UNION ALL SELECT 'SYMBOL', length('v_' || k) FROM s
UNION ALL SELECT 'VAR', length('α_' || k) FROM s UNION ALL SELECT 'VAR', 1 FROM s UNION ALL SELECT 'LITERAL', length('<APab_NUM_' || k || '>') FROM s) GROUP BY kind""")
def tok_formulas(spark, d):
    """four delimiters, symbols, variables and literal placeholders; what stands in a formula is no token of its own."""
    k = F.col("p_partkey").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    c = F.col("p_partkey") % 6
    formula = F.when(c == 0, cat("$x_", k, "$")).when(c == 1, cat("$$a = ", k, "$$")).when(c == 2, cat("\\(y^", k, "\\)")).when(c == 3, cat("\\[z - ", k, "\\]")).otherwise("")
    text = cat(formula, " with H", k, " and DNA, v_", k, " or α_", k, " by y in <APab_NUM_", k, "> here")
    found = fx.table(spark, d, "part").select(F.explode(tokens.scan(text)).alias("t"))
    return found.groupBy(F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("t.value")).alias("chars"))
