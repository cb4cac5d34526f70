"""DuckDB SQL of the queries that SQL can express."""

from gradeloom.llm import license_index as li
from gradeloom.llm.common import LOWER, UPPER, WORD


def words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM i WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
),
hit AS MATERIALIZED (SELECT g.rid, g.n, g.s, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.phrase = win.phrase),
n_hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hit USING (rid) LEFT JOIN items USING (rid)
"""


MIXING = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weights AS (SELECT source, n, pow(CAST(n AS DOUBLE), 0.5) AS weight FROM counts),
rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM weights) * (SELECT sum(n) FROM counts) / n AS rate FROM weights
),
plans AS (SELECT source, rate, CAST(ceil(rate / 8.0) AS INTEGER) AS parts, rate / CAST(ceil(rate / 8.0) AS INTEGER) AS mean FROM rates),
terms AS (
  SELECT source, k, exp(-mean) * pow(mean, k) / gamma(k + 1.0) AS p FROM plans, (SELECT unnest(range(0, 64)) AS k)
),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draws AS (
  SELECT row_number() OVER () AS rid, d.*, plans.source AS s, coalesce(CAST(doc_id AS VARCHAR), 'none:' || md5(coalesce(text, ''))) AS key, unnest(range(1, parts + 1)) AS part
  FROM documents d JOIN plans ON d.source IS NOT DISTINCT FROM plans.source
),
uniform AS (
  SELECT *, CAST('0x' || substr(md5('0:n:' || part || ':' || key), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM draws
),
copies AS (
  SELECT ANY_VALUE(uniform.doc_id) AS doc_id, ANY_VALUE(text) AS text, ANY_VALUE(lang) AS lang, ANY_VALUE(uniform.source) AS source,
    ANY_VALUE(n_chars) AS n_chars, ANY_VALUE(key) AS key, count(cdf.k) AS n
  FROM uniform LEFT JOIN cdf ON cdf.source IS NOT DISTINCT FROM s AND cdf.c <= u GROUP BY rid
),
each AS (SELECT doc_id, text, lang, source, n_chars, key, unnest(range(1, n + 1)) AS copy FROM copies)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5('0:place:' || copy || ':' || key) AS place FROM each
"""


def _rounds(name: str, seeds: str, edges: str, rounds: int = 12) -> str:
    """Unrolled rounds of a personalised PageRank; the last table is ``name``."""
    parts = [f"{name}_0 AS MATERIALIZED (SELECT host, seed * (1 - 0.85e0) AS score FROM {seeds})"]
    for k in range(1, rounds + 1):
        parts.append(f"""{name}_{k} AS MATERIALIZED (SELECT host, sum(part) AS score FROM (
  SELECT e.dst AS host, s.score / e.degree * 0.85e0 AS part FROM {edges} e JOIN {name}_{k - 1} s ON s.host = e.src
  UNION ALL SELECT host, score FROM {name}_0) GROUP BY host)""")
    return ",\n".join(parts)


_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)"""


def host_sql(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

LINK_GRAPH = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}),
located AS (
  SELECT row_number() OVER () AS rid, page_id, html, {host_sql("url")} AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
fits AS (
  SELECT rid, arg_max(verdict, length(rhost || rpath)) AS verdict, arg_max(rhost || rpath, length(rhost || rpath)) AS rule
  FROM located JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid
),
ruled AS MATERIALIZED (SELECT l.*, rule, verdict FROM located l LEFT JOIN fits USING (rid)),
hosts AS MATERIALIZED (
  SELECT host, avg(CASE verdict WHEN 'allow' THEN 1e0 ELSE 0e0 END) AS allowed, avg(CASE verdict WHEN 'block' THEN 1e0 ELSE 0e0 END) AS blocked
  FROM ruled WHERE host <> '' GROUP BY host
),
refs AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{_HREF}', 1)) AS link FROM located),
edges AS (
  SELECT DISTINCT src, dst FROM (SELECT src, {host_sql("regexp_replace(link, '^//', 'http://')")} AS dst FROM refs)
  WHERE src <> '' AND dst <> '' AND src <> dst
),
ahead AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM edges),
back AS MATERIALIZED (SELECT dst AS src, src AS dst, count(*) OVER (PARTITION BY dst) AS degree FROM edges),
good AS (SELECT host, allowed AS seed FROM hosts),
bad AS (SELECT host, blocked AS seed FROM hosts),
{_rounds("trust", "good", "ahead")},
{_rounds("distrust", "bad", "back")}
SELECT page_id, r.host, path, rule,
  coalesce(verdict, CASE WHEN round(coalesce(d.score, 0), 12) > round(coalesce(t.score, 0), 12)
    AND round(coalesce(d.score, 0), 12) >= 0.075 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN trust_12 t ON t.host = r.host LEFT JOIN distrust_12 d ON d.host = r.host
"""


def _licenses() -> str:
    indexed = list(enumerate(li.phrases()))
    phrase_rows = ", ".join(f"({k}, '{p.label}', {str(p.template).lower()}, {p.at}, {len(p.words)}, {i}, '{w}')" for k, p in indexed for i, w in enumerate(p.words))
    template_rows = ", ".join(f"('{label}', {i}, '{w}')" for label, ws in li.template_words().items() for i, w in enumerate(ws))
    return f"""
WITH p(phrase, label, template, site, length, off, word) AS (VALUES {phrase_rows}),
t(label, site, word) AS (VALUES {template_rows}),
vocab AS (SELECT word FROM p UNION SELECT word FROM t),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
tokens AS MATERIALIZED (SELECT rid, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d),
all_hits AS MATERIALIZED (SELECT rid, pos, word FROM tokens JOIN vocab USING (word)),
idf AS MATERIALIZED (
  SELECT word, ln((SELECT count(*) + 1 FROM d) / CAST(count(DISTINCT rid) + 1 AS DOUBLE)) AS idf
  FROM vocab LEFT JOIN all_hits USING (word) GROUP BY word
),
whole AS MATERIALIZED (
  SELECT rid, p.phrase, any_value(p.label) AS label, any_value(p.template) AS template, any_value(p.site) AS site, h.pos - p.off AS start
  FROM all_hits h JOIN p USING (word) GROUP BY rid, p.phrase, h.pos - p.off HAVING count(*) = any_value(p.length)
),
anchor AS (
  SELECT phrase, arg_min(word, (rank)) AS word FROM (
    SELECT phrase, word, row_number() OVER (PARTITION BY phrase ORDER BY idf DESC, word, off) AS rank FROM p JOIN idf USING (word)) GROUP BY phrase
),
files AS (SELECT DISTINCT rid FROM all_hits WHERE word IN (SELECT word FROM anchor)),
hits AS MATERIALIZED (SELECT * FROM all_hits WHERE rid IN (SELECT rid FROM files)),
rare AS MATERIALIZED (
  SELECT label, site, word, CASE WHEN max(idf) OVER (PARTITION BY label) > 0 THEN idf ELSE 1 END AS idf FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY idf DESC, word, site) AS r FROM t JOIN idf USING (word))
  WHERE r <= {li.RARE_WORDS}
),
weight AS (SELECT label, sum(idf) AS weight FROM rare GROUP BY label),
votes AS (
  SELECT h.rid, rare.label, h.pos - rare.site AS off, sum(rare.idf) AS vote FROM hits h JOIN rare ON rare.word = h.word GROUP BY ALL
),
aligned AS MATERIALIZED (SELECT rid, label, off, round(vote / weight, 6) AS coverage FROM votes JOIN weight USING (label)),
proven AS (
  SELECT rid, label, start - site AS off, count(DISTINCT phrase) AS found FROM whole WHERE template GROUP BY ALL
),
needed AS (SELECT label, count(DISTINCT phrase) AS needed FROM p WHERE template GROUP BY label),
matched AS (
  SELECT DISTINCT rid, label FROM aligned JOIN proven USING (rid, label, off) JOIN needed USING (label) WHERE coverage >= {li.COVERAGE} AND found = needed
),
base AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM whole WHERE NOT template GROUP BY rid),
more AS (SELECT rid, list(label) AS labels FROM matched GROUP BY rid),
scores AS (SELECT rid, least(max(coverage), 1) AS score FROM aligned GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid) LEFT JOIN scores USING (rid)
"""


LICENSES = _licenses()


NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""
