"""DuckDB statements for the queries that SQL can express, over whole tables.

Rules, templates and grids are given as the operators list them; the way to the result is plain:
no filters, indexes or orders, every rule and template is tried on everything.
"""

from __future__ import annotations

from workweave.llm.license_scan import PART, PHRASES, TEMPLATES, WHOLE
from workweave.llm.quality_rules import DELTA, GRID, RISK, SYMBOLS
from workweave.llm.url_filter import DOMAIN_RULES, PATTERN_RULES

STATEMENTS: dict[str, str] = {}

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: Shingle sets, pairs by shared shingles, and the least id by walking the links.
STATEMENTS["op2_ngram_jaccard"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3),
      lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
walk(doc_id, reach) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT walk.doc_id, links.b FROM walk JOIN links ON links.a = walk.reach),
least AS (SELECT doc_id, min(reach) AS component_id FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

#: The same with shingles of two words and another threshold.
STATEMENTS["op11_minhash_near_dedup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 2 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)
    AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
walk(doc_id, reach) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT walk.doc_id, links.b FROM walk JOIN links ON links.a = walk.reach),
least AS (SELECT doc_id, min(reach) AS component_id FROM walk GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id,
  d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

#: Phrases by comparing word lists at every place; templates by counting words of every line.
STATEMENTS["op3_license_scan"] = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), {_FOLD}) AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM d),
phrases(phrase, label) AS (VALUES {", ".join(f"(string_split({_text(p)}, ' '), {_text(b)})" for p, b in PHRASES)}),
p AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(words)),
    lambda i: words[i + 1:i + len(phrase)] = phrase)) AS place FROM w, phrases),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
    list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
templates(label, words) AS (VALUES {", ".join(f"({_text(b)}, list_distinct(string_split({_text(t)}, ' ')))" for b, t in TEMPLATES)}),
lines AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
hits AS (
  SELECT doc_id, t.label, len(list_intersect(t.words, l.words)) / len(t.words) AS c
  FROM lines l, templates t
  WHERE {WHOLE} * len(list_intersect(t.words, l.words)) >= {PART} * len(t.words)),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(
    coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_TESTS = ", ".join(f"('{rule}', {i}, {cut})" for rule, cuts in GRID.items()
                   for i, cut in enumerate(cuts))
_SHARES = " UNION ALL ".join(f"SELECT doc_id, lang, '{rule}' AS rule, {rule} AS share FROM m"
                             for rule in GRID)

#: Windows by grouping, binomial tails by log-gamma.
STATEMENTS["op4_quality_rules"] = f"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
places AS (
  SELECT doc_id, unnest(range(0, len(words) - 2)) AS i, words FROM w WHERE len(words) >= 3),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i + 1], words[i + 2], words[i + 3]) AS n
  FROM places),
covered AS (
  SELECT doc_id, count(DISTINCT word) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS word FROM windows WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    coalesce(covered.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
  FROM w LEFT JOIN covered USING (doc_id)),
m AS (
  SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbols,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_lines,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeats,
    coalesce(n_capitals / nullif(word_chars, 0), 0) AS capitals,
    coalesce(n_shouts / nullif(n_words, 0), 0) AS shouts FROM c),
shares AS ({_SHARES}),
tests(rule, step, cutoff) AS (VALUES {_TESTS}),
counts AS (
  SELECT lang, rule, step, cutoff::DOUBLE AS cutoff, count(*) AS n,
    count(*) FILTER (share > cutoff::DOUBLE) AS k
  FROM shares JOIN tests USING (rule)
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN k > {RISK / len(GRID)} * n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
      lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln({RISK / len(GRID)}) + (n - i) * ln(1 - {RISK / len(GRID)})))) END AS p,
    {DELTA / len(GRID)} / count(*) OVER (PARTITION BY rule, step) AS level FROM counts),
runs AS (
  SELECT *, bool_and(p <= level) OVER (PARTITION BY lang, rule ORDER BY step) AS held FROM tails),
cutoffs AS (SELECT lang, rule, min(cutoff) AS cutoff FROM runs WHERE held GROUP BY ALL),
failed AS (
  SELECT DISTINCT doc_id FROM shares s JOIN cutoffs c
    ON c.rule = s.rule AND c.lang IS NOT DISTINCT FROM s.lang WHERE share > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM m
"""

_DOMAINS = ", ".join(f"({_text(r.host)}, {_text(r.path)}, {_text(r.verdict)})" for r in DOMAIN_RULES)
_PATTERNS = ", ".join(f"({_text(r.name)}, {_text(r.pattern)})" for r in PATTERN_RULES)

#: Every rule is tried on every url.
STATEMENTS["op8_url_filter"] = f"""
WITH r AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), {_FOLD}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
domains(h, f, verdict) AS (VALUES {_DOMAINS}),
fits AS (
  SELECT page_id, max_by(h || f, length(h || f)) AS rule, max_by(verdict, length(h || f)) AS verdict
  FROM p JOIN domains ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)
  GROUP BY page_id),
patterns(name, pattern) AS (VALUES {_PATTERNS}),
matched AS (
  SELECT page_id, min(name) AS name FROM p JOIN patterns
    ON regexp_matches(translate(url, {_FOLD}), pattern) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(fits.verdict,
  CASE WHEN host <> '' AND matched.name IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  matched.name AS pattern_rule
FROM p LEFT JOIN fits USING (page_id) LEFT JOIN matched USING (page_id)
"""
