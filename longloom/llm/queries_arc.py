"""Query of the archive converter and its oracle."""

from __future__ import annotations

from . import arc_convert
from .common import read
from .registry import register

OP4_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
  sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""


@register("op4_arc_convert", OP4_SQL)
def op4_arc_convert(spark, sf_dir):
    """All pages as ARC archives, converted to WARC and read back."""
    return arc_convert.pages_through_archives(read(spark, sf_dir, "pages"))
