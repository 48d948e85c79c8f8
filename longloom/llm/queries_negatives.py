"""Query of the hard-negative miner and its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import hard_negatives
from .common import read
from .registry import register

# the relational definition: all scores of the anchors, ranked
OP11_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, a.label AS own, b.n, b.vec_id, b.label,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5),
h AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND s.label <> p.own
  WHERE 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5
"""


@register("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth row of the embeddings, with the labels of every seventh row moved on."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0).drop("label")
