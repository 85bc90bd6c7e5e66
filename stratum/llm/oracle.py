"""SQL that gives the same rows as the queries, where SQL can express them."""

from __future__ import annotations

import re

from stratum.llm import licenses, quality_rules
from stratum.llm.license_texts import TEMPLATES

SPACES = r"[\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')"


def quality() -> str:
    rules, steps = quality_rules.RULES, quality_rules.STEPS
    rejects = ", ".join(f"CASE WHEN {rules[rule][1]} > 0 AND 1000 * {rules[rule][0]} >= {c} * {rules[rule][1]} THEN {i} END" for i, (rule, c) in enumerate(steps, 1))
    p = quality_rules.ALPHA
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r}))))"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
grams AS (SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) AS j FROM again) GROUP BY r),
f AS (SELECT t.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    len(l) AS n_lines, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_capitals FROM t LEFT JOIN repeated ON t.r = repeated.r),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_min([{rejects}]) AS first_step FROM f),
holdout AS (SELECT lang, doc_id, min(coalesce(first_step, {len(steps) + 1})) AS step, bool_or(base_failed) AS base_failed
    FROM g WHERE doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1) GROUP BY lang, doc_id),
good AS (SELECT * FROM holdout WHERE NOT base_failed),
grid AS (SELECT lang, s, count(*) FILTER (step <= s) AS k, count(*) AS n FROM good, (SELECT unnest(range(1, {len(steps) + 1})) AS s) GROUP BY lang, s),
c AS (SELECT lang, max(s) AS certified FROM grid WHERE {tail} <= {quality_rules.DELTA!r} / (SELECT count(DISTINCT lang) FROM good) GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(first_step <= certified, false) AS kept FROM g LEFT JOIN c ON g.lang = c.lang"""


SUBSTRINGS = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
s AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t)),
o AS (SELECT k, min(doc_id) AS owner FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM s JOIN o ON s.k = o.k WHERE doc_id > owner),
p AS (SELECT t.r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM t),
kept AS (SELECT p.r, string_agg(x, ' ' ORDER BY p.j) AS words FROM p LEFT JOIN gone ON p.r = gone.r AND p.j = gone.j WHERE gone.j IS NULL GROUP BY p.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.words, '')) AS kept_sha256 FROM t LEFT JOIN kept ON t.r = kept.r LEFT JOIN n ON t.r = n.r"""

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {at}, 5) AS BIGINT) >> {shift}) & 31 AS INT) + 1, 1)" for at in range(1, 41, 5) for shift in (15, 10, 5, 0)
)
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, n AS payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM h"""

_ALNUM = f"regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAKS = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, i, i + 12) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
s AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, (SELECT DISTINCT n FROM k))),
m AS (SELECT r, i, s.n, item FROM s JOIN k ON s.g = k.g),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS own FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(own, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM t LEFT JOIN hit ON t.r = hit.r LEFT JOIN items ON t.r = items.r"""

NEAR = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '{SPACES}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT b, c FROM reach JOIN both_ways ON doc_id = a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.c, t.doc_id) AS component_id FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = t.doc_id"""


def license_scan() -> str:
    known = [(n, name, licenses.template_pairs(text), len(licenses.template_words(text))) for n, (name, text) in enumerate(TEMPLATES)]
    rows = ", ".join(f"({n}, '{name}', {len(own)}, {size}, {licenses.stride(size)}, '{pair}')" for n, name, own, size in known for pair in own)
    assert not re.search("[^a-z0-9 ]", "".join(p for _, _, own, _ in known for p in own))
    words = f"regexp_extract_all({LOWER.format('u')}, '[a-z0-9]+')"
    least = licenses.THRESHOLD
    return f"""
WITH k(template, license, size, n_words, stride, pair) AS (VALUES {rows}), kt AS (SELECT DISTINCT template, license, size, n_words, stride FROM k),
t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT r, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[\\x20\\x09\\x0B-\\x0D]*\\n'), [text])) AS u FROM t),
w AS (SELECT r, u, {words} AS w FROM u),
p AS (SELECT DISTINCT r, u, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT r, u, w, unnest(range(1, len(w))) AS i FROM w)),
s AS (SELECT r, u, count(*) AS size FROM p GROUP BY r, u),
d AS (SELECT p.r, p.u, k.template, k.license, 2.0 * count(*) / (s.size + k.size) AS dice FROM p JOIN k ON p.pair = k.pair JOIN s ON s.r = p.r AND s.u = p.u GROUP BY p.r, p.u, k.template, k.license, s.size, k.size),
unit AS (SELECT * FROM d WHERE dice >= {least!r}),
rest AS (SELECT a.r, a.w, kt.* FROM (SELECT t.r, w.w FROM t JOIN w ON w.r = t.r AND w.u = t.text) a JOIN (SELECT p.r, k.template FROM p JOIN t ON t.r = p.r AND t.text = p.u JOIN k ON k.pair = p.pair GROUP BY p.r, k.template, k.size HAVING count(*) >= CAST({least / (2 - least)!r} AS DOUBLE) * k.size - 1e-9) g ON a.r = g.r
  JOIN kt ON kt.template = g.template WHERE len(a.w) >= n_words AND NOT EXISTS (SELECT 1 FROM unit WHERE unit.r = a.r AND unit.template = kt.template)),
win AS (SELECT DISTINCT r, template, license, size, i, list_slice(w, i + 1, i + n_words) AS x FROM (SELECT *, unnest(list_append(range(0, len(w) - n_words + 1, stride), len(w) - n_words)) AS i FROM rest)),
wp AS (SELECT DISTINCT r, template, license, size, i, x[j] || ' ' || x[j + 1] AS pair FROM (SELECT *, unnest(range(1, len(x))) AS j FROM win)),
ws AS (SELECT r, template, i, count(*) AS n FROM wp GROUP BY r, template, i),
wd AS (SELECT wp.r, wp.i, wp.template, wp.license, 2.0 * count(*) / (ws.n + wp.size) AS dice FROM wp JOIN k ON k.template = wp.template AND k.pair = wp.pair JOIN ws ON ws.r = wp.r AND ws.template = wp.template AND ws.i = wp.i GROUP BY wp.r, wp.i, wp.template, wp.license, ws.n, wp.size),
best AS (SELECT r, template, license, dice, i FROM (SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY dice DESC, i) AS z FROM wd WHERE dice >= {least!r}) WHERE z = 1),
every AS (SELECT r, template, license, dice, u, CAST(NULL AS BIGINT) AS i FROM unit UNION ALL SELECT r, template, license, dice, NULL, i FROM best),
m AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, template, license, u) AS place, count(*) OVER (PARTITION BY r) AS n FROM every)
SELECT doc_id, coalesce(n, 0) AS n_matches, license, CAST(coalesce(template, -1) AS BIGINT) AS template, CAST(coalesce(dice, 0.0) AS DOUBLE) AS dice, i AS word FROM t LEFT JOIN m ON t.r = m.r AND place = 1"""


ORACLE = {
    "op1_quality_rules": quality(), "op2_substring_dedup": SUBSTRINGS, "op3_warc": WARC, "op5_decontamination": LEAKS, "op8_jaccard_join": NEAR, "op9_license_scan": license_scan(),
}
