"""DuckDB SQL for those queries that SQL can express; ids are taken to differ."""

from __future__ import annotations

from . import decontam, ngram_join, url_filter

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _low(column: str) -> str:
    return _LOWER.format(column)


OP3 = f"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
a AS (SELECT doc_id, line, {_SPACE.format(_low("x"))} AS w FROM l),
s AS (SELECT doc_id, line, list_sort(list_distinct(w)) AS ws FROM a WHERE len(w) > 0),
u AS (SELECT ws, min({{'d': doc_id, 'l': line}}) AS first, row_number() OVER () AS sid FROM s GROUP BY ws),
t AS (SELECT sid, first, len(ws) AS n, unnest(ws) AS word FROM u),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
p AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY df, word) AS pos FROM t JOIN f USING (word)),
q AS (SELECT * FROM p WHERE pos <= n - (n * 80 + 99) // 100 + 1),
c AS (SELECT DISTINCT x.sid AS a, y.sid AS b FROM q x JOIN q y ON x.word = y.word AND x.first < y.first WHERE least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80),
near AS (SELECT DISTINCT b AS sid FROM c JOIN u x ON x.sid = c.a JOIN u y ON y.sid = c.b
  WHERE len(list_intersect(x.ws, y.ws)) * 100 >= (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) * 80),
gone AS (SELECT s.doc_id, s.line FROM s JOIN u ON s.ws = u.ws WHERE {{'d': s.doc_id, 'l': s.line}} <> u.first OR sid IN (SELECT sid FROM near)),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id),
m AS (SELECT doc_id, count(*) FILTER (len(w) > 0) AS n_lines FROM a GROUP BY doc_id)
SELECT m.doc_id, n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM m LEFT JOIN g ON m.doc_id = g.doc_id
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_low("text"))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least({decontam.WINDOW}, len(w)) AS n FROM (SELECT item_id, {_ALNUM.format(_low("text"))} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_SPACE.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, host, text, line, {_SPACE.format(_low("line"))} AS lw FROM l),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n WHERE len(lw) > 0 GROUP BY doc_id),
fr AS (SELECT host, lw, count(DISTINCT text) AS c, count(DISTINCT doc_id) AS docs FROM n WHERE len(lw) > 0 GROUP BY host, lw),
ho AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
bad AS (SELECT fr.host, lw FROM fr JOIN ho ON fr.host = ho.host WHERE fr.c > 20 AND fr.docs > ho.docs * 0.05),
gone AS (SELECT doc_id, sum(len(n.lw)) AS n FROM n JOIN bad ON n.host = bad.host AND n.lw = bad.lw GROUP BY doc_id),
x AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS gone
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id),
y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - gone >= 20 AND n_words - gone >= n_words * 0.5 AS kept
FROM y
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE.format(_low("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + {ngram_join.GRAM - 1}) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {ngram_join.GRAM - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= {ngram_join.PERCENT} * (x.n + y.n - same)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id
"""



def _op4() -> str:
    size, bin_, last = 40, url_filter._BIN, url_filter.ORDER + 1
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]))
    pick = lambda i: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[i]}'" for r in rules) + " END"
    sql = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
v AS (SELECT *, {pick(0)} AS rule, {pick(1)} AS label, ('0x' || substr(sha256(url), 1, 2))::INT % 5 = 0 AS held,
    '^^^' || regexp_replace(regexp_replace({_low("regexp_replace(url, '(?s)^.*?://', '')")}, '[0-9]', '0', 'g'), '[^a-z0{url_filter._MARKS}]', '~', 'g') || '$' AS signs FROM u),
tr AS (SELECT label, substr(signs, i, {last}) AS gram FROM (SELECT label, signs, unnest(range(1, length(signs) - {last - 2})) AS i FROM v WHERE label IS NOT NULL AND NOT held)),
asked AS (SELECT url, any_value(signs) AS signs, any_value(label) AS label FROM v WHERE label IS NULL OR held GROUP BY url),
ag AS (SELECT url, label, substr(signs, i, {last}) AS gram FROM (SELECT url, label, signs, unnest(range(1, length(signs) - {last - 2})) AS i FROM asked)),
m0 AS (SELECT DISTINCT gram, 1.0::DOUBLE / {size} AS pa, 1.0::DOUBLE / {size} AS pb FROM ag)"""
    for k in range(last):
        sql += f""",
g{k} AS (SELECT substr(gram, {last - k}, {k + 1}) AS g, CAST(count(*) FILTER (label = 'allow') AS DOUBLE) AS a, CAST(count(*) FILTER (label = 'block') AS DOUBLE) AS b FROM tr GROUP BY 1),
c{k} AS (SELECT substr(g, 1, {k}) AS c, sum(a) AS na, sum(b) AS nb, CAST(count(*) FILTER (a > 0) AS DOUBLE) AS ta, CAST(count(*) FILTER (b > 0) AS DOUBLE) AS tb FROM g{k} GROUP BY 1),
m{k + 1} AS (SELECT gram, CASE WHEN coalesce(na, 0) + coalesce(ta, 0) > 0 THEN (coalesce(a, 0) + ta * pa) / (na + ta) ELSE pa END AS pa, CASE WHEN coalesce(nb, 0) + coalesce(tb, 0) > 0 THEN (coalesce(b, 0) + tb * pb) / (nb + tb) ELSE pb END AS pb
  FROM m{k} LEFT JOIN g{k} ON substr(gram, {last - k}, {k + 1}) = g LEFT JOIN c{k} ON substr(gram, {last - k}, {k}) = c)"""
    return sql + f""",
sc AS (SELECT url, label, CAST(sum(CAST(ln(pa) - ln(pb) AS DECIMAL(28, 12))) AS DOUBLE) / count(*) AS score FROM ag JOIN m{last} USING (gram) GROUP BY url, label),
bi AS (SELECT label, CAST(greatest(-200, least(200, floor(score / {bin_}))) AS INT) AS b FROM sc WHERE label IS NOT NULL),
ed AS (SELECT e, (SELECT count(*) FILTER (label = 'allow' AND b < e) / CAST(count(*) FILTER (label = 'allow') AS DOUBLE) + count(*) FILTER (label = 'block' AND b >= e) / CAST(count(*) FILTER (label = 'block') AS DOUBLE) FROM bi) AS wrong FROM (SELECT unnest(range(-200, 202)) AS e)),
be AS (SELECT list(e ORDER BY e) AS es FROM ed WHERE wrong <= (SELECT min(wrong) FROM ed) + 1e-12),
lim AS (SELECT es[len(es) // 2 + 1] * {bin_} AS at_ FROM be)
SELECT page_id, host, path, rule, coalesce(v.label, CASE WHEN sc.score >= (SELECT at_ FROM lim) THEN 'allow' ELSE 'block' END) AS verdict
FROM v LEFT JOIN sc ON v.label IS NULL AND sc.label IS NULL AND v.url = sc.url
"""


ORACLE_SQL = {"op3_line_dedup": OP3, "op4_url_filter": _op4(), "op5_decontamination": OP5, "op7_warc": OP7, "op9_quality": OP9, "op10_ngram_join": OP10}
