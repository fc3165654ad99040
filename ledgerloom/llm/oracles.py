"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

ORACLES = {}

ORACLES["op2_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio,
         (SELECT sum(source_size) FROM weighed)::DOUBLE * 1.5::DOUBLE AS total,
         (SELECT sum(weight) FROM weighed) AS weights
  FROM weighed
), filled AS (
  SELECT *, total - coalesce(sum(cap) OVER before, 0) AS rest,
         weights - coalesce(sum(weight) OVER before, 0) AS open
  FROM capped
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN ratio * open <= rest THEN cap
              ELSE weight * (SELECT arg_min(rest / open, ratio) FROM filled WHERE ratio * open > rest)
         END AS target,
         ('0x' || substr(md5(concat_ws(':', 'offset 0', source)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shift
  FROM filled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.shift,
         CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
         row_number() OVER (
           PARTITION BY s.source
           ORDER BY CASE WHEN size <= 0 THEN 0 ELSE length(bin(size)) * 16 + ((size * 16) >> length(bin(size))) END DESC,
                    md5(concat_ws(':', '0', s.doc_id))[1:13], s.doc_id, size) - 1 AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (floor(rate * (place + 1) + shift) - floor(rate * place + shift))::BIGINT AS copies,
       (floor(rate * (place + 1) + shift) - floor(rate * place + shift))::BIGINT * size AS taken
FROM placed
"""

ORACLES["op3_exact_dedup"] = r"""
WITH hashed AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first_value(doc_id) OVER stays AS keep_id, row_number() OVER stays AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM hashed
  WINDOW stays AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

ORACLES["op5_decontamination"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, words[i : i + least(len(words), 10) - 1] AS gram, least(len(words), 10) AS width
  FROM items, unnest(range(1, greatest(len(words) - 9, 1) + 1)) steps(i)
  WHERE len(words) > 0
), grams AS (
  SELECT doc_id, i, width, words[i : i + width - 1] AS gram
  FROM docs, (SELECT DISTINCT width FROM windows) widths, unnest(range(1, len(words) - width + 2)) steps(i)
), matches AS (
  SELECT g.doc_id, g.i, g.width, w.item_id FROM grams g JOIN windows w USING (gram, width)
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM matches, unnest(range(i, i + width)) steps(place) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM matches GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _centroids(rounds: int = 3) -> str:
    """Centroid clustering with the rounds written out; ``c<n>`` are the centroids after n of them."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (k.x[i] - c.x[i]) * (k.x[i] - c.x[i])))::BIGINT"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT rid, arg_min(c.cluster, ({distance}, c.cluster)) AS cluster, min({distance}) AS distance
  FROM kept k, c{n} c GROUP BY rid
)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT cluster, CASE WHEN n > 0 THEN list_transform(sums, lambda s: (s - ((s % n) + n) % n) // n) ELSE x END AS x
  FROM (SELECT c.cluster, any_value(c.x) AS x, count(a.rid) AS n,
               list_transform(range(1, 65), lambda i: list_sum(list_transform(list(k.x), lambda v: v[i]))::BIGINT) AS sums
        FROM c{n} c LEFT JOIN a{n} a USING (cluster) LEFT JOIN kept k USING (rid) GROUP BY c.cluster)
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: isfinite(v))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER first - 1)::INT AS cluster, x FROM kept
  WINDOW first AS (ORDER BY sha256('1:' || vec_id) NULLS LAST, x)
  QUALIFY row_number() OVER first <= 16
), {", ".join(steps)}, sums AS (
  SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster
)
SELECT k.vec_id, a.cluster, a.distance, s.cluster_inertia,
       (SELECT sum(cluster_inertia) FROM sums)::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM kept k JOIN a{rounds} a USING (rid) JOIN sums s USING (cluster) JOIN c{rounds} c USING (cluster)
"""


ORACLES["op12_centroids"] = _centroids()
