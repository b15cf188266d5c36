"""The same results in DuckDB SQL, where SQL can express them over whole tables."""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op1_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOWER}) AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > o.owner, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op2_source_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT AS h FROM documents),
c AS (SELECT *, CASE WHEN size < 16 THEN size
             ELSE 16 + (length(bin(size)) - 5) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS cls FROM d),
subs AS (SELECT greatest(1, ceil(max(n) / 256.0))::BIGINT AS subs FROM (SELECT count(*) AS n FROM c GROUP BY source, cls)),
b AS (SELECT c.*, h % subs AS sub FROM c, subs),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, sub, size, doc_id) AS rnk FROM b),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             2.0::DOUBLE * total AS cap, 1.5::DOUBLE * sum(total) OVER () AS budget FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + cap / w * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
             <= budget AS capped FROM w),
g AS (SELECT *, coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS spent, sum(w) FILTER (WHERE NOT capped) OVER () AS free FROM f),
t AS (SELECT source, total, CASE WHEN capped THEN cap ELSE least(cap, w * ((budget - spent) / free)) END AS target,
             ('0x' || substr(md5('mix-1:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM g),
r AS (SELECT k.doc_id, k.size, t.total, t.target, t.u, k.rnk, CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0 END AS rate
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target,
       (least(floor(rate * rnk + u) - floor(rate * (rnk - 1) + u), 2)::BIGINT * size)::BIGINT AS taken
FROM r
""",
    "op3_chat_format": r"""
WITH v AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24 + length(role) AS chars,
             row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
      FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (WHERE role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op4_exact_topk": r"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op5_warc_archive": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, unhex(sha1(h)) AS d, sha1(h) AS hx,
             min(page_id) OVER (PARTITION BY h) AS first FROM p),
e AS (SELECT *, [('0x' || substr(hx, 5 * k + 1, 5))::BIGINT FOR k IN range(8)] AS fives FROM x)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM e
""",
    "op7_url_filter": r"""
WITH RECURSIVE n AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {LOWER}), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM n),
rules(h, t, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
tag AS (SELECT url, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(?:script|style)\b.*?</(?:script|style)\s*>', ' ', 'gsi'),
        '<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>', 0, 'i')) AS tag FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
link AS (SELECT url, CASE
    WHEN regexp_matches(tag, '(?i)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\b.*http-equiv\s*=\s*["'']?\s*refresh') THEN regexp_extract(tag, '(?i)content\s*=\s*["'']?[\s\d.;,]*url\s*=\s*([^"''>]*)', 1) END AS t FROM tag),
target AS (SELECT url, CASE WHEN t LIKE '%://%' THEN t WHEN t LIKE '//%' THEN regexp_extract(url, '^[^:/?#]*:') || t
    WHEN t LIKE '/%' THEN regexp_extract(url, '^[^:/?#]*://[^/?#]*') || t ELSE regexp_extract(url, '^[^:/?#]*://[^/?#]*[^?#]*/') || t END AS t FROM link WHERE trim(coalesce(t, '')) <> ''),
node AS (SELECT DISTINCT u, translate(regexp_extract(u, '^([^:/?#]*://[^/?#]*)([^#]*)', 1), {LOWER}) || regexp_extract(u, '^([^:/?#]*://[^/?#]*)([^#]*)', 2) AS n
    FROM (SELECT url AS u FROM pages UNION SELECT t FROM target)),
edge AS (SELECT a.n AS a, b.n AS b FROM target JOIN node a ON a.u = url JOIN node b ON b.u = t WHERE a.n <> b.n AND a.n <> '' AND b.n <> ''),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
member AS (SELECT DISTINCT b AS n, translate(regexp_extract(b, '://([^/?#]*)', 1), {LOWER}) AS host, regexp_extract(b, '://[^/?#]*([^?#]*)', 1) AS path FROM reach),
ruled AS (SELECT n, arg_max(action, length(h || t)) AS action FROM member JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY n),
standing AS (SELECT a AS n FROM reach LEFT JOIN ruled ON ruled.n = b GROUP BY a HAVING bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false)),
own AS (SELECT DISTINCT url, arg_max(h || t, length(h || t)) AS rule, arg_max(action, length(h || t)) AS action
    FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY url)
SELECT page_id, host, path, own.rule, coalesce(own.action, CASE WHEN standing.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN own ON own.url = p.url LEFT JOIN node ON node.u = p.url LEFT JOIN standing ON standing.n = node.n
""".replace("{LOWER}", _LOWER),
    # every pair of different sets that shares a shingle is counted, so this is for small tables
    "op8_minhash_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END)) AS s FROM w),
g AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
h AS (SELECT rep, n, unnest(s) AS h FROM g),
p AS (SELECT a.rep AS a, b.rep AS b FROM h a JOIN h b ON a.h = b.h AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
      HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT rep AS node, rep AS seen FROM g UNION SELECT c.node, e.b FROM c JOIN e ON c.seen = e.a),
m AS (SELECT node, min(seen) AS component FROM c GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(m.component, s.doc_id) IS NOT DISTINCT FROM s.doc_id AS kept
FROM s LEFT JOIN g ON s.s = g.s AND s.doc_id IS NOT NULL LEFT JOIN m ON m.node = g.rep
""",
}
