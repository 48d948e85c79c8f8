"""Query of the MinHash near-duplicate operator and its oracle."""

from __future__ import annotations

from . import minhash_dedup
from .common import read
from .registry import register

# words, then distinct 2-word shingles, then all linked pairs by an inverted index on shingles
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
      WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
comp AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(comp.m, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(comp.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.doc_id = w.doc_id
"""


@register("op10_minhash_dedup", OP10_SQL)
def op10_minhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents on 2-word shingles at similarity 0.8."""
    r = minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, threshold=80)
    return r.withColumn("kept", r["doc_id"] == r["component_id"])
