"""SQL of the queries that SQL can say on whole tables. Ids are taken to be unique, as in the given tables."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: SHA-1 as base32: hex digits to bits, five bits to a letter.
OP1 = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
h AS (SELECT *, CAST(strlen(body) AS BIGINT) AS payload_bytes,
             array_to_string(list_transform(string_split(upper(sha1(body)), ''), lambda c: right(bin(strpos('0123456789ABCDEF', c) - 1 + 16), 4)), '') AS bits FROM p),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('{BASE32}', CAST(
             list_sum(list_transform(range(0, 5), lambda b: CAST(substr(bits, CAST(5 * k + b + 1 AS BIGINT), 1) AS INTEGER) * (16 // CAST(pow(2, b) AS INTEGER)))) + 1 AS BIGINT), 1)), '') AS payload_digest FROM h),
f AS (SELECT body, max(page_id) AS o FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> o THEN o END AS refers_to, url FROM d JOIN f USING (body)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS r FROM win JOIN twice USING (doc_id, s), range(0, 5) AS o(j) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS l FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(l, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
x AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 5 * n_words AS bad FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) AS f FROM x GROUP BY 1),
a AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ff FROM h),
q AS (SELECT *, f / n AS mean, f / n * (1 - f / n) AS spread FROM a),
rho AS (SELECT mean, CASE WHEN k < 2 OR spread = 0 THEN 1.0 / 11
               WHEN n - nn / n > k - 1 THEN least(greatest((ff - n * mean * mean - (k - 1) * spread) / ((n - nn / n - (k - 1)) * spread), 1e-4), 0.999)
               ELSE 1e-4 END AS r FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CAST(h.n AS BIGINT) AS n_host, CAST(h.f AS BIGINT) AS n_host_failed,
       round((h.f + mean * (1 / r - 1)) / (h.n + (1 / r - 1)), 9) AS host_rate, NOT base_failed AND (h.f + mean * (1 / r - 1)) / (h.n + (1 / r - 1)) <= 0.5 AS kept
FROM x JOIN h ON h.source IS NOT DISTINCT FROM x.source, rho
"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM win JOIN first USING (s), range(0, 50) AS o(j) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, count(gone.k) AS r, string_agg(x, ' ' ORDER BY words.k) FILTER (WHERE gone.k IS NULL) AS t
         FROM words LEFT JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Bytes as pairs of hex digits; windows that touch or overlap are one span.
OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, strlen(h) // 2 - 49)) AS p FROM d WHERE strlen(h) >= 100)),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY 1),
hit AS (SELECT doc_id, p FROM win JOIN first USING (s) WHERE f < doc_id),
new AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
num AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM new),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM num GROUP BY doc_id, g),
ends AS (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, strlen(h) // 2, strlen(h) // 2 FROM d),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS prev FROM ends),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a, b) AS k FROM gap JOIN d USING (doc_id) GROUP BY 1),
size AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS r, count(*) AS n FROM span GROUP BY 1)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN size USING (doc_id)
"""

OP9 = r"""
WITH u AS (SELECT page_id, lower(url) AS url, DATE '2024-01-01' + CAST(page_id * 7 % 360 AS INTEGER) AS day FROM pages),
h AS (SELECT *, nullif(regexp_extract(url, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1), '') AS host,
             list_filter(string_split(regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS steps FROM u),
l AS (SELECT *, string_split(host, '.') AS labels FROM h),
k AS (SELECT page_id, day, host, list_distinct(list_concat([host],
             list_transform(range(2, len(labels)), lambda i: array_to_string(labels[i:], '.')),
             list_transform(range(1, len(steps) + 1), lambda i: concat(host, '/', array_to_string(steps[1:i], '/'))))) AS keys FROM l WHERE host IS NOT NULL),
e AS (SELECT page_id, day, host, unnest(keys) AS key FROM k),
c AS (SELECT DISTINCT key, CAST(concat('0x', substr(md5(key), 1, 8)) AS BIGINT) AS code FROM e),
n AS (SELECT key, concat('list', code % 4) AS category, DATE '2024-01-01' + CAST(code % 360 AS INTEGER) AS day, CAST(code % 97 AS INTEGER) AS held FROM c WHERE code % 3 = 0),
ev AS (SELECT key, category, day, 'add' AS action FROM n UNION ALL SELECT key, category, day + held, 'remove' FROM n WHERE held > 9
       UNION ALL SELECT key, category, day + 2 * held, 'add' FROM n WHERE held > 60),
iv AS (SELECT key, category, action, day AS a, coalesce(lead(day) OVER (PARTITION BY key, category ORDER BY day), DATE '9999-12-31') AS b FROM ev),
hits AS (SELECT page_id, iv.key, category FROM e JOIN iv ON iv.key = e.key AND action = 'add' AND a <= e.day AND e.day < b),
best AS (SELECT page_id, count(*) AS n, first(key ORDER BY length(key) DESC, key, category) AS key, first(category ORDER BY length(key) DESC, key, category) AS category FROM hits GROUP BY 1)
SELECT page_id, strftime(day, '%Y-%m-%d') AS fetched, host, coalesce(best.n, 0) AS n_active, key AS active_key, category, coalesce(best.n, 0) > 0 AS listed
FROM h LEFT JOIN best USING (page_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT x AS u, y AS v FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edge.v FROM reach JOIN edge ON edge.u = reach.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Masks by bit: A 1, B 2, C 4, D 8, E 16. Subsets of filters before a step come from the letters that stand before it.
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, part, len(w) AS n, len(list_distinct(w)) AS u, len(t) AS c, len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS caps,
             regexp_matches(t, '[#$%&*|]') AS sym, min(doc_id) OVER (PARTITION BY t) AS o FROM d),
m AS (SELECT part, CASE WHEN n < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * u < 80 * n THEN 2 ELSE 0 END + CASE WHEN 100 * caps > 10 * c THEN 4 ELSE 0 END
             + CASE WHEN sym THEN 8 ELSE 0 END + CASE WHEN o < doc_id THEN 16 ELSE 0 END AS mask,
             coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM s LEFT JOIN labels USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS x FROM m GROUP BY 1, 2),
l(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT concat(p.c, q.c, r.c, s.c, t.c) AS filter_order FROM l p, l q, l r, l s, l t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b <> q.b AND p.b <> r.b AND p.b <> s.b
             AND p.b <> t.b AND q.b <> r.b AND q.b <> s.b AND q.b <> t.b AND r.b <> s.b AND r.b <> t.b AND s.b <> t.b),
st AS (SELECT filter_order, k AS step, (SELECT b FROM l WHERE c = substr(filter_order, k, 1)) AS bit,
              CAST(coalesce((SELECT sum(b) FROM l WHERE strpos(substr(filter_order, 1, k - 1), c) > 0), 0) AS INTEGER) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS k)),
x AS (SELECT part, filter_order, step, bit,
             CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN x ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM cell, st GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""


def _op13(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after another; vectors are taken to be equally long, in a multiple of the parts."""
    text = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
             FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS s FROM v, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, s AS c FROM x WHERE r <= {entries})"""
    for i in range(rounds + 1):
        text += f""",
d{i} AS (SELECT r, x.p, e, s, list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS q FROM x JOIN b{i} b ON b.p = x.p),
a{i} AS MATERIALIZED (SELECT r, p, any_value(s) AS s, arg_min(e, CAST(q AS HUGEINT) * {entries} + e) AS e, min(q) AS q FROM d{i} GROUP BY r, p)"""
        if i < rounds:
            text += f""",
m{i} AS (SELECT p, e, i, sum(y) AS t, count(*) AS n FROM (SELECT p, e, unnest(s) AS y, unnest(range(len(s))) AS i FROM a{i}) GROUP BY ALL),
n{i} AS (SELECT p, e, list(CAST((t - (t % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{i} GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN n{i} n ON n.p = b.p AND n.e = b.e)"""
    return text + f""",
row AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(q) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN row USING (r), book
"""


OP13 = _op13()
