"""DuckDB SQL for the queries of this package that SQL can express."""

OP5 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS original,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS normal
  FROM documents
), r AS (
  SELECT doc_id, normal,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS place,
         count(*) OVER (PARTITION BY normal) AS group_size
  FROM t
  WINDOW w AS (PARTITION BY normal ORDER BY length(original) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(normal) AS text_sha256 FROM r
"""

# The level at which targets are weight x level is found round by round, as the excess of sources
# that stop at twice their size is shared by the others.
OP6 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), s AS (
  SELECT source, source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM totals
), rounds(n, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT n + 1, (
    SELECT (150 * sum(source_size)
            - 200 * coalesce(sum(source_size) FILTER (WHERE weight * level > 2 * source_size), 0))::DOUBLE
           / (100 * sum(weight) FILTER (WHERE NOT weight * level > 2 * source_size))::DOUBLE
    FROM s)
  FROM rounds WHERE n < 60
), final AS (SELECT max(level) AS level FROM rounds), targets AS (
  SELECT source, source_size, least(weight * level, (2 * source_size)::DOUBLE) AS target
  FROM s, final
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)
                + (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
                   / 4503599627370496.0 < rate - floor(rate))::INT))::BIGINT AS taken
FROM rated
"""

ORACLES = {"op5_exact_dedup": OP5, "op6_mixing": OP6}
