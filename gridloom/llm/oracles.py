"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op5_exact_top_k"] = """
WITH numbered AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL
), parts AS (
  SELECT r, vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM numbered
), ints AS MATERIALIZED (
  SELECT r, vec_id, list(CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) ORDER BY i) AS v FROM parts
  GROUP BY r, vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))
), scored AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ints q JOIN ints c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op6_mixing"] = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w FROM sources
), caps AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps
), targets AS (
  SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE w * first_value(level) OVER (ORDER BY (ratio <= level), ratio, source NULLS LAST) END AS target FROM levels
), due AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(CAST(floor(t.target / t.source_size + 1e-12) AS BIGINT), 3) ELSE 0 END AS whole
  FROM sizes d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), rest AS (
  SELECT *, least(greatest(CAST(round(target) AS BIGINT) - whole * source_size, 0), source_size) AS rest,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':1'), 1, 12)) AS BIGINT) + 0.5e0) / 281474976710656e0 AS u FROM due
), sized AS (
  SELECT source, rest, size, CAST(count(*) AS BIGINT) AS n FROM rest GROUP BY source, rest, size
), runs AS (
  SELECT source, size, rest - coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS squares FROM sized
), trial AS (
  SELECT source, size, CASE WHEN squares > 0 THEN greatest(CAST(left_over AS DOUBLE), 0e0) / CAST(squares AS DOUBLE) ELSE 0e0 END AS rate FROM runs
), rates AS (
  SELECT source, coalesce(max(size) FILTER (rate * size < 1e0) + 1, 0) AS certain, coalesce(arg_max(rate, size) FILTER (rate * size < 1e0), 0e0) AS rate FROM trial GROUP BY source
), chances AS (
  SELECT r.*, a.certain, least(greatest(CASE WHEN size >= certain THEN 1e0 ELSE rate * size END, 1e-12), 1 - 1e-12) AS p
  FROM rest r JOIN rates a ON r.source IS NOT DISTINCT FROM a.source
), odds AS (
  SELECT *, CASE WHEN size >= certain THEN 0e0 ELSE (u / (1 - u)) / (p / (1 - p)) END AS odds FROM chances
), ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + least(greatest(rest - before, 0), size) AS BIGINT) AS taken FROM ranked
"""

#: crc32 by its table, byte by byte; a blob's bytes come from its hexadecimal digits.
_CRC = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), coded AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)
), bytes AS (
  SELECT w, list_transform(range(len(h) // 2), lambda k: CAST(16 * (instr('0123456789ABCDEF', substr(h, 2 * k + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(h, 2 * k + 2, 1)) - 1 AS BIGINT)) AS b FROM coded
), buckets AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc
)"""

ORACLES["op13_resampling"] = f"""
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), target AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), corpus AS MATERIALIZED (
  SELECT r, unnest(ws) AS w FROM rows
), words AS (
  SELECT w FROM corpus UNION SELECT w FROM target
), {_CRC}, source_counts AS (
  SELECT bucket, count(*) AS s FROM corpus JOIN buckets USING (w) GROUP BY bucket
), target_counts AS (
  SELECT bucket, count(*) AS t FROM target JOIN buckets USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM source_counts) + 10000) AS DOUBLE)
    / CAST((s + 1) * ((SELECT coalesce(sum(t), 0) FROM target_counts) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM source_counts LEFT JOIN target_counts USING (bucket)
), weights AS (
  SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM corpus JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM rows LEFT JOIN weights USING (r)
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM scored LEFT JOIN (SELECT r, rank FROM ranked WHERE rank <= 10 * eligible // 100) USING (r)
"""

ORACLES["op11_lexical_search"] = """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
), docs AS MATERIALIZED (
  SELECT r, doc_id, len(ts) AS n, ts FROM texts WHERE len(ts) > 0
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), items AS MATERIALIZED (
  SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS ts FROM benchmark
), asked AS MATERIALIZED (
  SELECT i, item_id, unnest(ts) AS t FROM items
), postings AS MATERIALIZED (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY r, t
), weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, totals GROUP BY t, n_docs
), scored AS (
  SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))) AS part
  FROM postings JOIN docs USING (r) JOIN weights USING (t), totals
), sums AS (
  SELECT i, item_id, r, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN scored USING (t) GROUP BY i, item_id, r
), ranked AS (
  SELECT i, item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM sums JOIN docs USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
