"""op1: the mix of all documents."""

from __future__ import annotations

from ..plans.registry import register
from . import mixing as M
from .common import documents

ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         length(text) AS chars,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln(u) / CASE WHEN size > 0 THEN (size / (size + 40.0::DOUBLE))
                       / (1.0::DOUBLE + ((chars::DOUBLE / size - 7.0::DOUBLE) / 4.0::DOUBLE)
                          * ((chars::DOUBLE / size - 7.0::DOUBLE) / 4.0::DOUBLE)) ELSE 1.0 END AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM k GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
o AS (
  SELECT *, cap * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= w * (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped
  FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap
              ELSE w * (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))
                   / sum(CASE WHEN NOT capped THEN w END) OVER () END::DOUBLE AS target
  FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
g AS (SELECT source, key, sum(size) AS size FROM k WHERE size > 0 GROUP BY source, key),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) AS upto FROM g)
SELECT k.doc_id, k.size, e.source_size, e.target,
       (k.size * (e.epochs + CASE WHEN r.upto IS NOT NULL AND target - epochs * source_size > 0
                   AND 2 * r.upto - r.size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
LEFT JOIN r ON k.source IS NOT DISTINCT FROM r.source AND k.key = r.key
"""


@register("op1_mixing", ORACLE)
def q_mixing(spark, sf_dir):
    return M.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
