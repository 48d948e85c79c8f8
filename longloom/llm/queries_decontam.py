"""Query of the decontamination operator and its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontam
from .common import read
from .registry import register

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# windows of items as strings, document word runs of the same length, equi-joined
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (
  SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
run AS (SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS k FROM (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, s, win.n, item_id FROM run JOIN win ON run.k = win.k AND run.n = win.n),
spot AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spot ON spot.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id
"""


@register("op7_decontam", OP7_SQL)
def op7_decontam(spark, sf_dir):
    """Words of all documents inside any 10-word window of a benchmark item."""
    r = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
