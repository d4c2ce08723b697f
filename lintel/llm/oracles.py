"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

import string

from .license_rules import signatures
from .mixing import BITS, LEVELS, MOST_REPEATS, SHARE_PERCENT, WEIGHTS
from .quality import RULES, STOP_WORDS

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_PLAIN = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def jaccard() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * same >= 75 * (a.n + b.n - same)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(l.n_links, 0) AS n_links FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id LEFT JOIN (SELECT x, count(*) AS n_links FROM e GROUP BY x) l ON l.x = d.doc_id"""


def quality() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    share = lambda items, test: f"len(list_filter({items}, lambda v: {test})) / nullif(CAST(len({items}) AS DOUBLE), 0)"
    tests = []
    for rule in RULES:
        parts = [f"{rule.measure} {sign} {limit}" for sign, limit in (("<", rule.least), (">", rule.most)) if limit is not None]
        tests.append(f"CASE WHEN n_words >= {rule.from_words} AND ({' OR '.join(parts)}) THEN '{rule.name}' END")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
{share("w", f"lower(v) IN ({stop})")} AS stop_word_ratio, {share("w", r"regexp_matches(v, '[A-Za-z\x{80}-\x{10FFFF}]')")} AS letter_word_ratio,
{share("w", r"regexp_matches(v, '^[^a-z\x{80}-\x{10FFFF}]*[A-Z]{2}[^a-z\x{80}-\x{10FFFF}]*$')")} AS upper_word_ratio,
{share("l", r"regexp_matches(v, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')")} AS ellipsis_line_ratio, {share("l", r"regexp_matches(v, '^[\x20\x09]*[-*\x{2022}]')")} AS bullet_line_ratio,
len(l) AS n_lines FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
r AS (SELECT *, word_chars / nullif(CAST(n_words AS DOUBLE), 0) AS mean_word_length, n_symbols / nullif(CAST(n_words AS DOUBLE), 0) AS symbol_ratio, n_dup_lines / nullif(CAST(n_lines AS DOUBLE), 0) AS dup_line_ratio FROM m),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {", ".join(tests)}) AS broken FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM b"""


def decontaminate() -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
v AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, x.n, item FROM x JOIN v ON v.n = x.n AND v.g = x.g),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id"""


def mixing() -> str:
    weights = f"[{', '.join(map(str, WEIGHTS))}]"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_PLAIN}')) AS BIGINT) AS size, CAST('0x' || substr(md5(concat('0-', coalesce(CAST(doc_id AS VARCHAR), text, ''))), 1, 8) AS BIGINT) >> {32 - BITS * LEVELS} AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST({weights}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w FROM d GROUP BY source),
o AS (SELECT *, {MOST_REPEATS}.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY {MOST_REPEATS}.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE_PERCENT / 100}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, k) FROM l WHERE level <= cap / w) * w, cap)) AS target FROM l),
b AS (SELECT *, CASE WHEN target > source_size THEN target - source_size ELSE target END AS budget FROM t),
c AS (SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
f AS (SELECT b.source, source_size, target, arg_min(CASE WHEN (budget - (upto - size)) * 2 > size THEN h + 1 ELSE h END, h) FILTER (upto > budget) AS threshold FROM b JOIN c ON c.source IS NOT DISTINCT FROM b.source GROUP BY ALL)
SELECT d.doc_id, d.size, f.source_size, f.target, d.size * (CASE WHEN f.target > f.source_size THEN 1 ELSE 0 END + CASE WHEN threshold IS NULL OR h < threshold THEN 1 ELSE 0 END) AS taken FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source"""


def licenses() -> str:
    """All signatures over all texts, without the gate. Words stand between two blanks, so that neighbouring matches do not share one."""
    doubled = lambda p: p.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    rules = ", ".join(f"({s.order}, '{s.label}', {s.priority}, {s.weight}::DOUBLE, '{s.keyword}', ' (?:{doubled(s.pattern)}) ', {str(s.base).upper()})" for s in signatures())
    words = lambda s: f"(length({s}) - length(replace({s}, ' ', ''))) // 2"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, concat(' ', array_to_string(w, '  '), ' ') AS t FROM d),
r(o, label, p, weight, keyword, pattern, base) AS (VALUES {rules}),
x AS (SELECT doc_id, r.*, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS between FROM n JOIN r ON contains(replace(t, '  ', ' '), keyword)),
h AS (SELECT doc_id, o, label, p, weight, base, unnest(range(1, len(m) + 1)) AS i, m, between FROM x WHERE len(m) > 0),
s AS (SELECT doc_id, o, label, p, weight, base, CAST({words("concat(array_to_string(between[1:i], ''), array_to_string(m[1:i - 1], ''))")} AS BIGINT) AS s, CAST({words("m[i]")} AS BIGINT) AS l FROM h),
k AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.p >= a.p AND b.s <= a.s AND b.s + b.l >= a.s + a.l AND (b.s < a.s OR b.l > a.l OR (b.l = a.l AND (b.p > a.p OR (b.p = a.p AND b.o < a.o))))) AS kept FROM s a),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR kept) AS labels, max(weight) FILTER (kept) AS score FROM k GROUP BY doc_id)
SELECT n.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM n LEFT JOIN g ON g.doc_id = n.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses(), "op5_ngram_jaccard_join": jaccard(), "op6_quality_rules": quality(), "op9_decontaminate": decontaminate(), "op10_mix_sources": mixing()}
