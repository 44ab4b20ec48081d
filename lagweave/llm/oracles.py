"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op3_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), fill AS (
  SELECT 0.0::DOUBLE AS level, 0 AS round
  UNION ALL
  SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM w)
           - coalesce((SELECT sum(cap) FROM w WHERE cap < weight * level), 0))
         / (SELECT sum(weight) FROM w WHERE cap >= weight * level), round + 1
  FROM fill WHERE round < 40
), lv AS (SELECT max(level) AS level FROM fill),
p AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM lv)) AS target FROM w),
q AS (
  SELECT d.doc_id, d.size, d.h, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), r AS (
  SELECT *, whole + CASE WHEN target - whole * source_size > 0 AND middle < target - whole * source_size THEN 1 ELSE 0 END AS copies FROM q
)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM r
"""

SQL["op2_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1), '' ORDER BY i) AS payload_digest
  FROM p, range(32) t(i) GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM g JOIN b USING (page_id)
"""

SQL["op6_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

SQL["op10_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
runs AS (
  SELECT doc_id, i AS start, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(0, len(w) - size + 1) + 1)) AS i FROM d, sizes)
), hit AS (SELECT runs.doc_id, runs.start, runs.size, win.item_id FROM runs JOIN win USING (win, size)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + size)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
), post AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
counts AS (SELECT term, count(*) AS n FROM post GROUP BY term),
terms AS (
  SELECT win, term, min(off) AS off FROM (SELECT win, unnest(string_split(win, ' ')) AS term, unnest(range(1, size + 1)) AS off FROM (SELECT DISTINCT win, size FROM win)) GROUP BY win, term
), ranked AS (
  SELECT win, term, count(*) OVER (PARTITION BY win) AS m, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), off, term) AS rank FROM terms LEFT JOIN counts USING (term)
), asked AS (
  SELECT win, term, greatest(1, CAST(ceil(m * 0.8::DOUBLE - 0.000000001::DOUBLE) AS BIGINT)) AS need FROM ranked WHERE rank <= m - greatest(1, CAST(ceil(m * 0.8::DOUBLE - 0.000000001::DOUBLE) AS BIGINT)) + 1
), spot AS (
  SELECT doc_id, term, list_slice(w, greatest(1, pos - 9), pos + 9) AS around FROM (SELECT DISTINCT term FROM asked) JOIN post USING (term) JOIN d USING (doc_id)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM (
    SELECT DISTINCT doc_id, win
    FROM (SELECT doc_id, win, need, around, string_split(win, ' ') AS ws FROM spot JOIN asked USING (term) WHERE len(list_intersect(list_distinct(around), string_split(win, ' '))) >= need)
    WHERE len(list_filter(range(1, 11), lambda j: len(list_intersect(list_distinct(list_slice(around, j, j + 9)), ws)) >= need)) > 0
  ) JOIN win USING (win)
  GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds, unrolled: every part meets every entry of its codebook."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
  SELECT x.row, x.p, c.e, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS dist FROM x JOIN c{r} c ON x.p = c.p AND x.j = c.j GROUP BY x.row, x.p, c.e
), a{r} AS (
  SELECT row, p, e, dist FROM (SELECT *, row_number() OVER (PARTITION BY row, p ORDER BY dist, e) AS nr FROM d{r}) WHERE nr = 1
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT a.p, a.e, x.j, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN x ON a.row = x.row AND a.p = x.p GROUP BY a.p, a.e, x.j
), c{r + 1} AS (
  SELECT c.p, c.e, c.j, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x
  FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e AND c.j = m.j
)""")
    chain = ", ".join(steps)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), flat AS (
  SELECT row, w, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM kept
), x AS (
  SELECT row, CAST(i // w AS BIGINT) AS p, CAST(i % w AS BIGINT) AS j, CAST(floor(4096 * CAST(v AS DOUBLE)) AS BIGINT) AS x FROM flat
), c0 AS (
  SELECT p, CAST(row - 1 AS BIGINT) AS e, j, x FROM x WHERE row <= {entries}
), {chain}, coded AS (
  SELECT row, string_agg('0' || substr('0123456789abcdef', CAST(e AS INTEGER) + 1, 1), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY row
), book AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS sha FROM c{rounds})
SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, (SELECT sha FROM book) AS codebooks_sha256
FROM coded o JOIN kept k USING (row)
"""


SQL["op11_vector_codes"] = vector_codes_sql()


def found_sql(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern in t(doc_id, text): kind, place among the kinds, start, end; places follow from the pieces between the matches."""
    return f"""
SELECT doc_id, '{kind}' AS kind, {place} AS place, b AS start, b + len(m[i]) AS stop
FROM (
  SELECT doc_id, m, g, i, CAST(list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS b
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, string_split_regex(text, '{pattern}') AS p FROM t))
) WHERE len(g[i]) >= {least}"""


ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SQL["secrets_base"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found_sql("assign", 0, ASSIGN, 1, 8)} UNION ALL {found_sql("access", 1, "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {found_sql("hex", 2, "[0-9a-f]+", 0, 32)}),
g AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS line
  FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(line, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)
"""

SQL["lm_base"] = r"""
WITH crc(i, c) AS (SELECT i, i FROM range(0, 256) t(i)),
step AS (
  WITH RECURSIVE s AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM crc UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM s WHERE k < 8)
  SELECT list(c ORDER BY i) AS tab FROM s WHERE k = 8
), h AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
         lambda a, b: xor(a // 256, tab[1 + (xor(a, b) & 255)])), 4294967295) % 5 AS r
  FROM documents, step
), w AS (
  SELECT doc_id, r = 1 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM h
), tok AS (SELECT doc_id, held_out, unnest(list_append(w, '')) AS t FROM w),
n AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t),
total AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM n)
SELECT doc_id, held_out, count(*) AS n_tokens, count(n.c) AS n_known, any_value(total.n) AS train_tokens, round(sum(log10((coalesce(n.c, 0) + 0.5::DOUBLE) / (total.n + 0.5::DOUBLE * (total.v + 1)))), 6) AS base_score
FROM tok LEFT JOIN n USING (t), total GROUP BY doc_id, held_out
"""
