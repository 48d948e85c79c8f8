"""Query of the ranked lexical search and its oracle."""

from __future__ import annotations

from . import lexical_search
from .common import read
from .registry import register

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

# every document with a term of the item is scored, then ranked
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
i AS (SELECT item, item_id, unnest(list_distinct(ws)) AS term FROM (
  SELECT row_number() OVER () AS item, item_id, {_TERMS} AS ws FROM benchmark)),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, s GROUP BY term),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ws) * n_docs) // l) AS m FROM d, s WHERE len(ws) > 0),
score AS (SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 10
"""


@register("op13_lexical_search", OP13_SQL)
def op13_lexical_search(spark, sf_dir):
    """The ten best documents for the text of every benchmark item."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
