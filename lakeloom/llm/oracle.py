"""What DuckDB runs to check queries that SQL can express; written from the contracts, without cells, anchors or passes."""

from __future__ import annotations

from .licenses import BASE, TEMPLATES
from .mixing import WEIGHTS
from .url_filter import ADDRESS, RULES, two_labels

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, unnest(range(length(h) // 2 - 99)) AS i, h FROM d WHERE length(h) >= 200),
g AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS k FROM s),
f AS (SELECT k, min(struct_pack(a := doc_id, b := i)) AS first FROM g GROUP BY k),
r AS (SELECT doc_id, i FROM g JOIN f USING (k) WHERE struct_pack(a := doc_id, b := i) > first),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS begins FROM r),
n AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM n GROUP BY doc_id, span),
q AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM p),
t AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last,
             string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""

_PHRASES = ", ".join(f"({k}, {i}, '{w}', {len(p.split())}, '{label}')" for k, (p, label) in enumerate(BASE.items()) for i, w in enumerate(p.split()))
_POSTINGS = ", ".join(
    f"({k}, '{t.label}', {i}, '{w}', {len(t.words)}, {str(t.key[0] <= i < t.key[1]).lower()}, {t.key[1] - t.key[0]})" for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.words)
)
OP2 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM w),
ph(k, i, w, n, label) AS (VALUES {_PHRASES}),
pt(t, label, i, w, n, key, n_key) AS (VALUES {_POSTINGS}),
b AS (SELECT doc_id, k, o.p - ph.i AS start, any_value(label) AS label FROM o JOIN ph ON o.w = ph.w GROUP BY doc_id, k, o.p - ph.i HAVING count(*) = any_value(n)),
bs AS (SELECT doc_id, count(*) AS n_base, min(start) AS a, max(start) AS z, list(DISTINCT label) AS labels FROM b GROUP BY doc_id),
hits AS (SELECT o.doc_id, pt.t, o.p - pt.i AS start FROM o JOIN pt ON o.w = pt.w AND pt.key GROUP BY o.doc_id, pt.t, o.p - pt.i HAVING count(*) = any_value(pt.n_key)),
ok AS (SELECT h.doc_id, h.t, h.start, any_value(pt.label) AS label, count(*) / any_value(pt.n) AS share
       FROM hits h JOIN pt ON h.t = pt.t JOIN o ON o.doc_id = h.doc_id AND o.p = h.start + pt.i AND o.w = pt.w
       GROUP BY h.doc_id, h.t, h.start),
me AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS score FROM ok GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(bs.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(me.labels, [])))), ',') AS labels,
       CAST(greatest(coalesce(score, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS score
FROM w LEFT JOIN bs ON w.doc_id = bs.doc_id LEFT JOIN me ON w.doc_id = me.doc_id"""

OP4 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
                  (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/mix'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(f"{w:g}" for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS w FROM s),
l AS (SELECT *, source_size * 2.0::DOUBLE / w AS "full",
  (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
  / sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(w * (SELECT arg_min(level, "full") FROM l WHERE level <= "full"), source_size * 2.0::DOUBLE)) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS copies FROM t),
p AS (SELECT *, target - copies * source_size AS rest FROM c),
k AS (SELECT p.source, CAST(length(bin(size)) AS DOUBLE) AS v, any_value(rest) AS rest, sum(size) AS words FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE size > 0 GROUP BY p.source, length(bin(size))),
i AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(words * v) OVER (PARTITION BY source ORDER BY v DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM k),
y AS (SELECT source, max(v) AS top, arg_max(greatest((rest - before) / after, 0), v) AS factor, arg_max(before, v) AS sure FROM i WHERE (rest - before) / after * v <= 1 GROUP BY source),
o AS (SELECT d.doc_id, d.size, d.source, d.u, p.source_size, p.target, p.copies, p.rest - coalesce(y.sure, 0) AS rest,
  CASE WHEN size = 0 OR p.rest <= 0 THEN 0 WHEN y.top IS NULL OR length(bin(size)) > y.top THEN 1 ELSE y.factor * CAST(length(bin(size)) AS DOUBLE) END AS p
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source),
q AS (SELECT doc_id, size, source, source_size, target, copies + CASE WHEN p >= 1 THEN 1 ELSE 0 END AS copies, rest,
  CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM o),
x AS (SELECT *, CASE WHEN q IS NOT NULL AND sum(size) FILTER (WHERE q IS NOT NULL) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS extra FROM q),
g AS (SELECT source, max(rest) - sum(size * extra) AS gap FROM x GROUP BY source),
m AS (SELECT x.source, min(struct_pack(o := abs(size - gap), q := q, i := doc_id)) AS b FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source
      WHERE q IS NOT NULL AND extra = 0 AND abs(size - gap) < gap GROUP BY x.source)
SELECT doc_id, size, source_size, target, CAST(size * (copies + CASE WHEN doc_id = b.i THEN 1 ELSE extra END) AS BIGINT) AS taken
FROM x LEFT JOIN m ON x.source IS NOT DISTINCT FROM m.source"""

#: The statistics and base limits of OP5, without what is learned.
STATISTICS = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8) AS x),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM c WHERE n > 1) AS x GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s"""

_TWO, _ADDRESS = f"regexp_matches(name, '{two_labels()}')", f"regexp_matches(name, '{ADDRESS}')"


def _tail(n: int) -> str:
    return f"array_to_string(list_slice(string_split(name, '.'), -{n}, -1), '.')"


def _level(name: str, key: str, above: str, on: str) -> str:
    return f"""{name}_g AS (SELECT g.*, u.mean AS p FROM (SELECT {key}, sum(n) AS n, sum(k) AS k FROM c GROUP BY {key}) g JOIN {above} u ON {on}),
{name}_s AS (SELECT CASE WHEN coalesce(sum(n), 0) <= count(*) THEN 0.5 ELSE least(0.99, greatest(0.01,
   (sum(n * pow(k / n - p, 2) / (p * (1 - p))) / sum(n) - count(*) / sum(n)) / (1 - count(*) / sum(n)))) END AS rho FROM {name}_g WHERE n > 0),
{name}_e AS (SELECT {key}, k + (1 / rho - 1) * p AS a, n - k + (1 / rho - 1) * (1 - p) AS b, (k + (1 / rho - 1) * p) / (n + (1 / rho - 1)) AS mean FROM {name}_g, {name}_s)"""


_CASES = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.prefix}'" for r in sorted(RULES, key=lambda r: (-len(r.prefix), r.prefix))
)
_SAID = " ".join(f"WHEN '{r.prefix}' THEN '{r.verdict}'" for r in RULES)
OP7 = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LETTERS}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE {_CASES} END AS rule FROM h),
j AS (SELECT *, CASE rule {_SAID} END AS said FROM f),
e AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(said) AS n, count(*) FILTER (WHERE said = 'block') AS k FROM j GROUP BY host),
c AS (SELECT host, n, k, CASE WHEN {_ADDRESS} THEN name WHEN {_TWO} THEN {_tail(3)} ELSE {_tail(2)} END AS domain,
             CASE WHEN {_ADDRESS} THEN 'address' WHEN {_TWO} THEN {_tail(2)} ELSE {_tail(1)} END AS suffix FROM e),
a AS (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS mean FROM c),
{_level("suffix", "suffix", "a", "true")},
{_level("domain", "suffix, domain", "suffix_e", "g.suffix = u.suffix")},
{_level("host", "suffix, domain, host", "domain_e", "g.suffix = u.suffix AND g.domain = u.domain")}
SELECT page_id, j.host AS host, path, rule,
       coalesce(said, CASE WHEN mean - sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN host_e ON j.host = host_e.host"""

OP9 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13) AS x),
f AS (SELECT k, min(doc_id) AS m FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (k) WHERE doc_id > m),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
t AS (SELECT a.doc_id, count(r.j) AS gone, string_agg(word, ' ' ORDER BY a.j) FILTER (WHERE r.j IS NULL) AS kept FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.j = r.j GROUP BY a.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)"""

OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
c AS (SELECT vec_id AS a, vec_id AS root FROM v UNION SELECT p.a, c.root FROM c JOIN p ON p.b = c.a),
m AS (SELECT a AS vec_id, min(root) AS component_id FROM c GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)"""
