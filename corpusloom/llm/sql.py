"""DuckDB SQL for the queries that SQL can express."""

#: The CRC-32 table is made by its rule: eight shifts of each byte, with the reversed polynomial.
OP4 = r"""
WITH RECURSIVE step(n, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8),
bytes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
  list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)) AS bs FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(bs, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM bytes, tab),
placed AS (SELECT doc_id, size::BIGINT AS size, text_crc32, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM crc),
dealt AS (SELECT doc_id, size, text_crc32, least((2 * before + size) * 24 // (2 * total), 23)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM dealt
"""

OP7 = r"""
WITH docs AS (
  SELECT doc_id,
         CASE WHEN regexp_extract(coalesce(source, ''), '(\d{1,9})$', 1) = '' THEN 'other'
              ELSE 'dom' || (regexp_extract(source, '(\d{1,9})$', 1)::BIGINT % 4) END AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+'))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS leaf_tokens FROM docs GROUP BY ALL),
target AS (SELECT floor(sum(leaf_tokens)::DOUBLE * 0.6::DOUBLE)::BIGINT AS t FROM leaves),
nodes AS (
  SELECT *, leaf_tokens * 4 AS capacity, 1 AS w3,
         CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w2,
         CASE domain WHEN 'dom0' THEN 4 WHEN 'dom1' THEN 3 WHEN 'dom2' THEN 2 ELSE 1 END AS w1
  FROM leaves),
langs AS (SELECT domain, lang, w1, w2, sum(capacity)::BIGINT AS capacity FROM nodes GROUP BY ALL),
domains AS (SELECT domain, w1, sum(capacity)::BIGINT AS capacity FROM langs GROUP BY ALL),
d0 AS (SELECT domain, capacity, w1 AS w, least((SELECT t FROM target), sum(capacity) OVER ())::DOUBLE AS budget FROM domains),
d1 AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (ORDER BY capacity::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (ORDER BY capacity::DOUBLE / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM d0),
d2 AS (SELECT domain, least(capacity::DOUBLE, w * max(level) OVER ()) AS budget FROM d1),
l0 AS (SELECT domain, lang, langs.capacity, w2 AS w, budget FROM langs JOIN d2 USING (domain)),
l1 AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity::DOUBLE / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (PARTITION BY domain ORDER BY capacity::DOUBLE / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM l0),
l2 AS (SELECT domain, lang, least(capacity::DOUBLE, w * max(level) OVER (PARTITION BY domain)) AS budget FROM l1),
s0 AS (SELECT domain, lang, source, leaf_tokens, nodes.capacity, w3 AS w, budget FROM nodes JOIN l2 USING (domain, lang)),
s1 AS (
  SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (PARTITION BY domain, lang ORDER BY capacity::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s0),
s2 AS (
  SELECT domain, lang, source, leaf_tokens,
         floor(least(capacity::DOUBLE, w * max(level) OVER (PARTITION BY domain, lang)) + 1e-6::DOUBLE)::BIGINT AS budget
  FROM s1),
plan AS (
  SELECT domain, lang, source,
         CASE WHEN leaf_tokens > 0 THEN budget // leaf_tokens ELSE 0 END AS epochs,
         CASE WHEN leaf_tokens > 0 THEN budget % leaf_tokens ELSE 0 END AS rest
  FROM s2),
ordered AS (
  SELECT doc_id, domain, lang, source, n_tokens, epochs, rest,
         sum(n_tokens) OVER (
           PARTITION BY domain, lang, source
           ORDER BY md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, 'null')), doc_id, n_tokens
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens,
       least(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END, 4)::INTEGER AS copies
FROM ordered WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""

ORACLE_SQL = {"op4_byte_shards": OP4, "op7_source_mix": OP7}
