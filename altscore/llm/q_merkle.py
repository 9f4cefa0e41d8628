"""op12: the Merkle manifest of all documents, every proof checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import register
from . import merkle as M
from .common import documents

# crc32 by its table (made from the polynomial), levels by recursion: a key's
# nodes halve until one is left; the languages' roots are a key of their own.
ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i::UBIGINT] || [0::UBIGINT FOR j IN range(8)],
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
d AS (
  SELECT doc_id, source, lang, n_chars, text,
         coalesce(xor(list_reduce([4294967295::UBIGINT] || [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
                                  lambda a, b: xor(t[(xor(a, b) & 255)::INT + 1], a >> 8)), 4294967295::UBIGINT) % 7 = 0, false) AS tampered
  FROM documents, crc),
f AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS key,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS own,
         CASE WHEN tampered THEN coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-')
              ELSE coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') END AS other,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d),
leaves AS MATERIALIZED (
  SELECT doc_id, key, sha256(head || own || tail) AS leaf, sha256(head || other || tail) AS claimed,
         row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, sha256(head || own || tail)) - 1 AS i
  FROM f),
trees AS (
  SELECT key, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY key) AS n FROM leaves
  UNION ALL
  SELECT key, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM trees WHERE n > 1 GROUP BY key, i // 2),
subroots AS MATERIALIZED (
  SELECT key, level, h, row_number() OVER (ORDER BY key) - 1 AS i FROM trees WHERE n = 1),
top AS (
  SELECT 0 AS level, i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2
  FROM top WHERE n > 1 GROUP BY i // 2),
nodes AS MATERIALIZED (
  SELECT key, level, i, h, n FROM trees WHERE n > 1
  UNION ALL SELECT NULL, level, i, h, n FROM top WHERE n > 1),
start AS (
  SELECT l.doc_id, l.key, l.leaf, l.claimed, l.i AS pos, s.h AS subroot, s.level AS steps, s.i AS lang_at
  FROM leaves l JOIN subroots s USING (key)),
walk AS (
  SELECT row_number() OVER () AS doc, doc_id, key, leaf, subroot, steps, lang_at, 0 AS step, pos, claimed AS h, '' AS proof FROM start
  UNION ALL
  SELECT w.doc, w.doc_id, w.key, w.leaf, w.subroot, w.steps, w.lang_at, w.step + 1,
         CASE WHEN w.step + 1 = w.steps THEN w.lang_at ELSE w.pos // 2 END,
         sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END), w.proof || coalesce(s.h, '')
  FROM (SELECT * REPLACE (CASE WHEN step = 0 AND steps = 0 THEN lang_at ELSE pos END AS pos) FROM walk) w
  JOIN (SELECT coalesce(key, '/') AS k, level, i, n FROM nodes) own
    ON own.k = CASE WHEN w.step < w.steps THEN w.key ELSE '/' END
   AND own.level = CASE WHEN w.step < w.steps THEN w.step ELSE w.step - w.steps END AND own.i = w.pos
  LEFT JOIN (SELECT coalesce(key, '/') AS k, level, i, h FROM nodes) s
    ON s.k = own.k AND s.level = own.level AND s.i = xor(w.pos, 1)),
done AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY doc ORDER BY step DESC) = 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = r.h AS verified
FROM done, (SELECT h FROM top WHERE n = 1) r
"""


@register("op12_merkle", ORACLE)
def q_merkle(spark, sf_dir):
    return M.proofs(M.manifest(documents(spark, sf_dir), tampered=tampered(F.col("doc_id"))))


def tampered(doc_id):
    """Where 7 divides the unsigned crc32 of the id in decimal."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))
