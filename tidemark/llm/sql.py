"""DuckDB statements of the operators that SQL can express, stated from their contracts.

Toxicity scores and surrogates have none. Those for repeated windows,
near-duplicates and benchmark windows compare everything with everything and
are meant for small tables.
"""

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s0 AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, 3 * source_size AS cap,
        (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s0),
f AS (SELECT *, cap / weight AS fill, sum(source_size) OVER () AS total,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM s),
lv AS (SELECT arg_min((total - before) / weight_left, fill) AS level FROM f
       WHERE fill >= (total - before) / weight_left),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM lv), 'inf'::DOUBLE) * weight) AS target
      FROM s),
g AS (SELECT doc_id, source, size, 1 + length(bin(size::BIGINT)) / 32.0::DOUBLE AS g FROM d),
k0 AS (SELECT source, g, sum(size)::DOUBLE AS words FROM g GROUP BY source, g),
k AS (SELECT k0.source, g, target,
        coalesce(sum(words) OVER (PARTITION BY k0.source ORDER BY g DESC
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
        sum(words * g) OVER (PARTITION BY k0.source ORDER BY g DESC
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass
      FROM k0 JOIN t ON k0.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, arg_max((target - 3 * above) / mass, g) AS c FROM k
      WHERE mass > 0 AND (target - 3 * above) / mass * g <= 3 GROUP BY source),
e AS (SELECT g.doc_id, g.source, g.size, t.source_size, t.target,
        CASE WHEN g.size > 0 THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(c.c, 3.0::DOUBLE) * g.g))
             ELSE 0.0::DOUBLE END AS expected
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
             LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source),
u AS (SELECT *, floor(expected)::BIGINT AS sure, expected - floor(expected) AS lam,
        (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE + 0.5)
          / 4503599627370496.0::DOUBLE AS u FROM e),
r AS (SELECT *, CASE WHEN lam > 0 THEN (u / (1 - u)) / (lam / (1 - lam)) END AS rnk,
        sum(size * sure) OVER (PARTITION BY source) AS sure_words FROM u),
x AS (SELECT *, CASE WHEN lam > 0 AND sum(size) OVER (PARTITION BY source, lam > 0 ORDER BY rnk, doc_id
          ROWS UNBOUNDED PRECEDING) <= target - sure_words THEN 1 ELSE 0 END AS extra FROM r),
y AS (SELECT *, target - sum(size * (sure + extra)) OVER (PARTITION BY source) AS gap FROM x),
z AS (SELECT *, CASE WHEN lam > 0 AND extra = 0 AND size > 0 AND abs(size - gap) < gap THEN 1 ELSE 0 END AS may FROM y),
w AS (SELECT *, row_number() OVER (PARTITION BY source, may ORDER BY abs(size - gap), rnk, doc_id) AS nth FROM z)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (sure + extra + CASE WHEN may = 1 AND nth = 1 THEN 1 ELSE 0 END)::INTEGER AS copies,
  ((sure + extra + CASE WHEN may = 1 AND nth = 1 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM w
"""

OP3 = f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{WS}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
n AS (SELECT page_id, body, h, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS g FROM p),
q AS (SELECT page_id, body, array_to_string(list_transform(range(32), lambda j:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((g[j // 4 + 1] >> (5 * (3 - j % 4))) & 31) + 1)::INTEGER, 1)), '') AS digest
      FROM n)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER (PARTITION BY body) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER (PARTITION BY body) THEN max(page_id) OVER (PARTITION BY body) END AS refers_to
FROM q
"""

OP6 = """
WITH p AS (
  SELECT page_id, url, make_timestamp((1640995200 + (page_id * 104729 % 17520) * 3600)::BIGINT * 1000000) AS fetched_at,
    nullif(lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)), '') AS host,
    regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1) AS path,
    regexp_extract(url, '^[^:]*://[^/]*(/[^/?#]*/)', 1) AS folder FROM pages),
ev AS (
  SELECT CASE WHEN page_id // 3 % 2 = 0 THEN 'spam' ELSE 'adult' END AS list,
    CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN CASE WHEN folder <> '' THEN host || folder END
      ELSE regexp_replace(host, '^[^.]*\\.', '') END AS pattern,
    CASE WHEN page_id // 6 % 3 = 0 THEN 'remove' ELSE 'add' END AS action,
    make_timestamp((1640995200 + (page_id * 7919 % 17520) * 3600)::BIGINT * 1000000) AS ts FROM p),
e1 AS (SELECT list, pattern, ts, max(action) AS action FROM ev WHERE pattern IS NOT NULL GROUP BY ALL),
iv AS (SELECT list, pattern, action, ts, lead(ts) OVER (PARTITION BY list, pattern ORDER BY ts) AS until FROM e1),
lk AS (
  SELECT DISTINCT page_id, fetched_at, pattern FROM (
    SELECT page_id, fetched_at, unnest(list_transform(range(1, greatest(2, len(string_split(host, '.')))),
      lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS pattern FROM p WHERE host IS NOT NULL
    UNION ALL
    SELECT page_id, fetched_at, unnest(list_transform(range(1, len(string_split(path, '/')) - 1),
      lambda i: host || array_to_string(string_split(path, '/')[:i + 1], '/') || '/')) FROM p WHERE host IS NOT NULL)),
m AS (
  SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM lk JOIN iv ON lk.pattern = iv.pattern AND action = 'add' AND fetched_at >= ts
    AND (until IS NULL OR fetched_at < until) GROUP BY page_id)
SELECT page_id, fetched_at, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(lists, '') AS lists,
  n_active IS NOT NULL AS blocked
FROM p LEFT JOIN m USING (page_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
        FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win)
         WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM late, (SELECT unnest(range(20)) AS k)),
wd AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
         FROM wd ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
x AS (
  SELECT *, [replace(replace(replace(replace(replace(replace(v, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'),
    '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') FOR v IN [role, text]] AS safe FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (length('<|begin|>') + sum(length('<|turn|><|says|><|end|>') + length(safe[1]) + length(safe[2])))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

OP9 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORD}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
       GROUP BY ALL),
ln AS (SELECT u, v FROM pr JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
       WHERE 100 * common >= 75 * (x.n + y.n - common)),
rc AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT rc.a, ln.v FROM rc JOIN ln ON rc.b = ln.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.c AS component_id, d.doc_id = k.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM rc GROUP BY a) k ON k.a = d.doc_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{ALNUM}') AS w FROM benchmark),
pt AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
ls AS (SELECT DISTINCT l FROM pt),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s
       FROM d, ls, LATERAL (SELECT unnest(range(1, len(w) - l + 2)) AS i)),
h AS (SELECT doc_id, item_id, i, pt.l FROM dw JOIN pt ON dw.l = pt.l AND dw.s = pt.s),
hw AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, LATERAL (SELECT unnest(range(l)) AS k) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: zlib's CRC-32 of a decimal number, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT,
    list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)),
    lambda acc, ch: list_reduce(list_prepend(xor(acc, ch), list_transform(range(8), lambda z: 0::UBIGINT)),
      lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

OP11 = f"""
WITH d0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {CRC32.format("doc_id")} AS h FROM documents),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10 % len(w))::BIGINT END AS a FROM d0),
d2 AS (SELECT *, 1 + (n - a) // (3 + (g % 8)::BIGINT) AS p FROM d1),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w
        ELSE list_transform(range(n), lambda i: w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END) + 1]) END AS w FROM d2),
gr AS (SELECT doc_id, i, hash(array_to_string(w[i + 1:i + 8], ' ')) AS k, array_to_string(w[i + 1:i + 8], ' ') AS s
       FROM d, LATERAL (SELECT unnest(range(n - 7)) AS i)),
eq AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM gr a JOIN gr b ON a.doc_id = b.doc_id AND a.k = b.k AND a.s = b.s AND b.i > a.i),
isl AS (SELECT doc_id, q, min(i) AS s, max(i) + 8 + q AS e FROM (
          SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM eq) GROUP BY doc_id, q, grp),
ru AS (SELECT doc_id, s, e - s AS l, min(q) AS q FROM isl WHERE e - s >= greatest(24, 3 * q) GROUP BY doc_id, s, e),
ag AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM ru GROUP BY doc_id),
top AS (SELECT * FROM (SELECT doc_id, s, l, q, row_number() OVER (PARTITION BY doc_id ORDER BY (l::DOUBLE / q) DESC, s, q) AS nth FROM ru)
        WHERE nth = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM ru),
wd AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM wd ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period,
  (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256,
  sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN ag USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Exact search: what the trees find at factor one, and on small tables at larger ones.
OP12 = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), {AZ}) AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source)
      GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + l.v)::HUGEINT AS p,
        1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v)::HUGEINT AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL = {"op1_pareto_mix": OP1, "op3_stream_dedup": OP3, "op4_warc_normalise": OP4, "op6_url_asof": OP6,
              "op7_repeat_windows": OP7, "op8_chat_format": OP8, "op9_minhash": OP9, "op10_wu_manber": OP10,
              "op11_periodic_runs": OP11, "op12_vantage_points": OP12,
              "op13_source_divergence": OP13}
