"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, line_dedup, quality, url_filter

ORACLE_SQL: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def rule_sql(rules: list[url_filter.Rule], pick) -> str:
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{pick(r)}'" for r in ranked) + " END"


def strength_sql(source: str, n: str, y: str) -> str:
    """One row with k, the prior strength of a level."""
    p = url_filter.Reputation()
    return f"""(SELECT CASE WHEN k IS NULL OR k < 2 OR room <= 0 OR rho <= 0 THEN {p.most_strength} ELSE least(greatest((1 - rho) / rho, {p.least_strength}), {p.most_strength}) END AS v
FROM (SELECT k, room, (yy - n * m * m - m * (1 - m) * (k - 1)) / nullif(room, 0) AS rho FROM (SELECT *, m * (1 - m) * (n - nn / n - (k - 1)) AS room
FROM (SELECT count(*) AS k, sum({n})::DOUBLE AS n, sum({y})::DOUBLE / sum({n}) AS m, sum({n}::DOUBLE * {n}) AS nn, sum({y}::DOUBLE * {y} / {n}) AS yy FROM {source} WHERE {n} > 0))))"""


def op1(rules: list[url_filter.Rule]) -> str:
    p = url_filter.Reputation()
    pattern, bare = url_filter.domain_pattern(p.suffixes), "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
    return f"""WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
seen AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
known AS (SELECT host, count(*) AS n, sum(bad)::BIGINT AS y FROM (SELECT DISTINCT page_id, host, bad FROM seen JOIN bad ON doc_id = page_id) GROUP BY host),
hosts AS (SELECT host, coalesce(n, 0) AS n, coalesce(y, 0) AS y, {bare} AS bare FROM (SELECT DISTINCT host FROM seen) LEFT JOIN known USING (host)),
h AS (SELECT *, regexp_matches(bare, '{url_filter.IPV4}') OR starts_with(bare, '[') AS ip, regexp_extract(bare, '{pattern}') AS found FROM hosts),
hs AS (SELECT host, n, y, CASE WHEN ip OR found = '' THEN bare ELSE found END AS domain, CASE WHEN ip THEN 'ip' WHEN found = '' THEN bare ELSE regexp_extract(bare, '{pattern}', 1) END AS suffix FROM h),
dm AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y FROM hs GROUP BY ALL), sx AS (SELECT suffix, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y FROM dm GROUP BY 1),
al AS (SELECT (sum(y) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS m FROM sx),
ks AS (SELECT v FROM {strength_sql('sx', 'n', 'y')}), kd AS (SELECT v FROM {strength_sql('dm', 'n', 'y')}), kh AS (SELECT v FROM {strength_sql('hs', 'n', 'y')}),
sm AS (SELECT suffix, (y + (SELECT v FROM ks) * (SELECT m FROM al)) / (n + (SELECT v FROM ks)) AS m FROM sx),
dd AS (SELECT domain, (dm.y + (SELECT v FROM kd) * sm.m) / (dm.n + (SELECT v FROM kd)) AS m FROM dm JOIN sm USING (suffix)),
hm AS (SELECT host, (hs.y + (SELECT v FROM kh) * dd.m) / (hs.n + (SELECT v FROM kh)) AS m, hs.n + (SELECT v FROM kh) AS w FROM hs JOIN dd USING (domain)),
lo AS (SELECT host, m - ({p.z} - {(p.z * p.z - 1) / 6} * 2 * (1 - 2 * m) * sqrt(w + 1) / ((w + 2) * sqrt(m * (1 - m)))) * sqrt(m * (1 - m) / (w + 1)) > {p.threshold} AS blocked FROM hm)
SELECT page_id, seen.host, path, {rule_sql(rules, lambda r: r.text)} AS rule, coalesce({rule_sql(rules, lambda r: r.verdict)}, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM seen LEFT JOIN (SELECT host AS h, blocked FROM lo) lo ON lo.h = seen.host"""


ORACLE_SQL["op2_line_dedup"] = rf"""WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM x),
t AS (SELECT doc_id, pos, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l), u AS (SELECT * FROM t WHERE length(line) >= {line_dedup.LEAST}),
f AS (SELECT line, min({{'d': doc_id, 'a': pos}}) AS first FROM u GROUP BY 1),
near AS (SELECT DISTINCT b.line FROM f a JOIN f b ON left(a.line, 11) = left(b.line, 11) AND a.first < b.first AND a.line <> b.line AND abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= {line_dedup.MAX_EDITS}
UNION SELECT DISTINCT b.line FROM f a JOIN f b ON right(a.line, 11) = right(b.line, 11) AND a.first < b.first AND a.line <> b.line AND abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= {line_dedup.MAX_EDITS}),
g AS (SELECT doc_id, pos, {{'d': doc_id, 'a': pos}} > first AS exact, near.line IS NOT NULL AS near FROM u JOIN f USING (line) LEFT JOIN near USING (line)),
r AS (SELECT doc_id, count(*) FILTER (exact) AS e, count(*) FILTER (near AND NOT exact) AS n, list(pos ORDER BY pos) AS removed FROM g WHERE exact OR near GROUP BY 1)
SELECT x.doc_id, len(a) AS n_lines, coalesce(e, 0) AS n_exact, coalesce(n, 0) AS n_near, coalesce(array_to_string(removed, ','), '') AS removed FROM x LEFT JOIN r ON r.doc_id = x.doc_id"""

ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
BASE32 = " || ".join(f"substr({ALPHABET}, ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLE_SQL["op3_warc"] = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages), w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM w"""

ORACLE_SQL["op4_minhash"] = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 4 THEN list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' ')) WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), way AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(d, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, way.b FROM r JOIN way ON way.a = r.t), m AS (SELECT d, min(t) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN m ON m.d = w.doc_id"""

R = quality.LineRules()
FAILS = rf"""((n - length(regexp_replace(line, '[|•·»›]', '', 'g'))) / n > {R.separators} OR (n - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) / n > {R.symbols} OR (n - length(replace(line, '!', ''))) / n > {R.shouting}
OR (n <= {R.short} AND regexp_matches(line, '(?i){"|".join(quality.BOILERPLATE)}')) OR (n <= {R.tiny} AND NOT regexp_matches(line, '[.!?…。！？:;,)\]"''»”’][\x20\x09-\x0D]*$')))"""
ORACLE_SQL["op5_quality_rules"] = rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS a FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(a) - 3)) AS i, unnest(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' '))) AS g FROM w WHERE len(a) >= 5),
tw AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1), cv AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tw, range(5) r(j) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w), f AS (SELECT doc_id, line, length(line) AS n, regexp_matches(line, '[^\x20\x09-\x0D]') AS word FROM l),
ls AS (SELECT doc_id, count(*) FILTER (word) - count(DISTINCT line) FILTER (word) AS dup, sum(n) AS total, sum(n) FILTER (NOT word OR NOT {FAILS}) AS good FROM f GROUP BY 1),
j AS (SELECT w.doc_id, len(a) AS n_words, length(array_to_string(a, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(cv.n, 0) AS n_repeat_words, coalesce(1 - coalesce(good, 0) / nullif(total, 0), 0) AS lost FROM w JOIN ls ON ls.doc_id = w.doc_id LEFT JOIN cv ON cv.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {R.most_lost} AS kept FROM b"""

WORDS8 = rf"regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op8_decontaminate"] = rf"""WITH b AS (SELECT item_id, {WORDS8} AS a FROM benchmark), bw AS (SELECT DISTINCT item_id, least(len(a), 10) AS m, unnest(list_transform(range(1, len(a) - least(len(a), 10) + 2), lambda i: array_to_string(a[i:i + least(len(a), 10) - 1], ' '))) AS g FROM b WHERE len(a) > 0),
d AS (SELECT doc_id, {WORDS8} AS a FROM documents), ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, unnest(range(1, len(a) - m + 2)) AS i, unnest(list_transform(range(1, len(a) - m + 2), lambda i: array_to_string(a[i:i + m - 1], ' '))) AS g FROM d, ms WHERE len(a) >= m),
h AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.g = dw.g), c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT doc_id, m, i FROM h), range(10) r(j) WHERE j < m GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(a) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

ORACLE_SQL["op9_substring_dedup"] = rf"""WITH d AS (SELECT doc_id, {WORDS} AS a FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(a) - 18)) AS i, unnest(list_transform(range(1, len(a) - 18), lambda i: array_to_string(a[i:i + 19], ' '))) AS g FROM d WHERE len(a) >= 20),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w) WHERE n > 1), c AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM r, range(20) q(j) GROUP BY 1),
k AS (SELECT d.doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS word FROM d) d ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM c) x ON x.doc_id = d.doc_id AND x.i = d.i GROUP BY 1)
SELECT d.doc_id, len(a) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

T = chat.Template()
CONTROLS = T.control_pattern().replace("\\ ", " ")
FIXED = "CASE role " + " ".join(f"WHEN '{name}' THEN {len(a) + len(b) + 2}" for name, (a, b) in T.turns.items()) + f" ELSE {len(T.other[0]) + len(T.other[1]) + len(T.other_name) + 4} + esc(role) END"
ESCAPED = f"(length({{0}}) + len(regexp_extract_all({{0}}, '{CONTROLS}')))"
ORACLE_SQL["op10_chat_format"] = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS i, coalesce(lag(role) OVER w, 'start') AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum({ESCAPED.format('text')} + {FIXED.replace('esc(role)', ESCAPED.format('role'))})::BIGINT AS formatted_chars, bool_and((before || '>' || role) IN ({', '.join(f"'{a}>{b}'" for a, b in T.moves)})) AND bool_or(i = n AND role IN ({', '.join(f"'{x}'" for x in T.final)})) AS valid FROM o GROUP BY conv_id"""
