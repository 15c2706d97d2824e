"""The same results in DuckDB SQL, written from the contracts and not from the operators' plans."""

from __future__ import annotations

from . import quality_rules as q

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || chr(31) || coalesce(source, '-') || chr(31) || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
k AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w,
    CAST(coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_before
  FROM s WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(total - cap_before AS DOUBLE) * w > CAST(cap AS DOUBLE) * (all_w - w_before) AS capped FROM k),
f AS (SELECT *, CAST(total - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE) AS free, CAST(sum(w) FILTER (NOT capped) OVER () AS BIGINT) AS free_w FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE free * w / free_w END AS target FROM f),
g AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, target - whole * source_size AS rest, CAST(sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
    CAST(sum(size) OVER (PARTITION BY source, h) AS BIGINT) AS own FROM g)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN upto <= rest OR (rest > 0 AND upto - own <= rest AND 2 * (rest - (upto - own)) >= own) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u
"""

NEAR_DEDUP_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.h FROM s JOIN c USING (h)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
g AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(g.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(g.least, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g ON g.a = d.doc_id
"""

_COMMON = ", ".join(f"('{lang}', '{w}')" for lang, ws in q.COMMON_WORDS.items() for w in ws)
_CLASSES = ", ".join(f"{{'k': '{k}', 'c': length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))}}" for k, p in q.CLASSES.items())
_TERM = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"

QUALITY_RULES_SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
b AS (SELECT doc_id, lang, t, w, len(w) AS n, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, n - 6)) AS i FROM b WHERE n >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
common(cl, word) AS (VALUES {_COMMON}),
cc AS (SELECT doc_id, lang, length(t) AS chars, x.k AS k, x.c AS c FROM (SELECT doc_id, lang, t, unnest([{_CLASSES}]) AS x FROM b)),
co AS (SELECT doc_id, lang, chars, k, c FROM cc UNION ALL SELECT doc_id, any_value(lang), any_value(chars), 'other', any_value(chars) - sum(c) FROM cc GROUP BY doc_id),
good AS (SELECT doc_id FROM b LEFT JOIN rep USING (doc_id) WHERE n >= 20 AND 100 * coalesce(n_repeat, 0) <= 30 * n),
enough AS (SELECT lang, sum(length(t)) AS chars, sum(n) AS words FROM b JOIN good USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {q.MIN_DOCS}),
rc AS (SELECT lang, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM co JOIN good USING (doc_id) WHERE lang IN (SELECT lang FROM enough WHERE chars >= {q.MIN_SUPPORT}) GROUP BY lang, k),
dc AS (SELECT doc_id, min(v) AS v FROM (SELECT doc_id, r.lang, sqrt(greatest(0, sum({_TERM}) / 2)) AS v FROM (SELECT doc_id, r.lang, c / chars AS p, r.q FROM co JOIN rc r USING (k) WHERE chars >= {q.MIN_CHARS} AND co.lang IN (SELECT lang FROM rc)) r GROUP BY doc_id, r.lang) GROUP BY doc_id),
wo AS (SELECT doc_id, lower(x) AS word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM b) WHERE lower(x) IN (SELECT word FROM common) GROUP BY ALL),
wf AS (SELECT b.doc_id, b.lang, b.n, m.cl, m.word AS k, coalesce(wo.c, 0) AS c FROM b CROSS JOIN common m LEFT JOIN wo ON wo.doc_id = b.doc_id AND wo.word = m.word),
wh AS (SELECT * FROM wf UNION ALL SELECT doc_id, any_value(lang), any_value(n), cl, '', any_value(n) - sum(c) FROM wf GROUP BY doc_id, cl),
rw AS (SELECT cl, k, sum(c) / sum(sum(c)) OVER (PARTITION BY cl) AS q FROM wh JOIN good USING (doc_id) WHERE lang = cl AND lang IN (SELECT lang FROM enough WHERE words >= {q.MIN_SUPPORT / 100}) GROUP BY cl, k),
dw AS (SELECT doc_id, min(v) AS v FROM (SELECT doc_id, cl, sqrt(greatest(0, sum({_TERM}) / 2)) AS v FROM (SELECT doc_id, cl, c / n AS p, rw.q FROM wh JOIN rw USING (cl, k) WHERE n >= {q.MIN_WORDS} AND wh.lang IN (SELECT cl FROM rw)) GROUP BY doc_id, cl) GROUP BY doc_id),
j AS (SELECT b.*, coalesce(rep.n_repeat, 0) AS n_repeat, b.n < 20 OR 100 * coalesce(rep.n_repeat, 0) > 30 * b.n AS failed, dc.v AS vc, dw.v AS vw
  FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN dc USING (doc_id) LEFT JOIN dw USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT coalesce(vc > {q.MAX_CLASS_DISTANCE}, false) AND NOT coalesce(vw > {q.MAX_WORD_DISTANCE}, false) AS kept
FROM j
"""

REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, unnest(range(1, octet_length(b) + 1)) AS i, unnest(range(1, octet_length(b) + 1)) + 199 <= octet_length(b) AS fits FROM d),
w AS (SELECT p.r, i, CASE WHEN fits THEN md5(array_slice(b, i, i + 199)) END AS h, array_slice(b, i, i) AS c FROM p JOIN d USING (r)),
k AS (SELECT h FROM w WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
m AS (SELECT w.*, CASE WHEN k.h IS NULL THEN 0 ELSE 1 END AS again FROM w LEFT JOIN k USING (h)),
g AS (SELECT r, i, c, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY r ORDER BY i) AS before FROM g),
a AS (SELECT r, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(hex(c), '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""

DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(n, 0) AS HUGEINT) + 5)) // (total + 5 * v.v) AS p
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000 * (CAST(sum(n) AS HUGEINT) + 5)) // (CAST(sum(sum(n)) OVER (PARTITION BY lang) AS HUGEINT) + 5 * any_value(v.v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50
"""
