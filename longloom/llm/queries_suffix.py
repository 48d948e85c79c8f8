"""Query of the suffix-array operator and its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import suffix_dedup
from .common import read
from .registry import register

# all 100-byte strings (in hex), all but the first of each content, islands of the covered bytes
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS s FROM d WHERE len(h) >= 200)),
again AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
step AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM again),
isle AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s - p > 100 THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id ORDER BY s) AS g FROM step),
span AS (SELECT doc_id, g, min(s) AS a, max(s) + 100 AS e FROM isle GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM span),
cut AS (SELECT gap.doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last,
    string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept
  FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""


@register("op6_suffix_dedup", OP6_SQL)
def op6_suffix_dedup(spark, sf_dir):
    """Repeated 100-byte strings of all documents."""
    r = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))
