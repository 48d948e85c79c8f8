"""Query of the source mixing operator and its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing
from .common import read
from .registry import register

LIMIT = 2.0

# the exponent in closed form: the repetitions span (p_max / p_min) ** (1 - a)
OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '-') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
  substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, {mixing.BLOCK_DIGITS}) AS b FROM documents),
sums AS (SELECT s, b, CAST(sum(n) AS BIGINT) AS t FROM d GROUP BY s, b),
tot AS (SELECT s, CAST(sum(t) AS BIGINT) AS t FROM sums GROUP BY s HAVING sum(t) > 0),
e AS (SELECT CASE WHEN max(t) / min(t) <= {LIMIT} THEN 0 ELSE 1 - ln({LIMIT}) / ln(max(t) / min(t)) END AS a, sum(t) AS total FROM tot),
r AS (SELECT s, t, pow(t / total, a) AS x FROM tot, e),
w AS (SELECT s, t, round(x / (SELECT sum(x) FROM r), {mixing.DIGITS}) AS weight FROM r),
o AS (SELECT s, t, weight, CAST(floor(weight * (SELECT max(CAST(ceil(t / weight) AS BIGINT)) FROM w)) AS BIGINT) AS own FROM w),
p AS (SELECT s, t, weight, own // t AS passes, own % t AS rest FROM (
  SELECT s, t, weight, CASE WHEN own < t AND own + 1 >= t THEN t ELSE own END AS own FROM o)),
q AS (SELECT sums.s, b, sums.t, weight, passes, rest, sum(sums.t) OVER (PARTITION BY sums.s
  ORDER BY md5('mix:' || sums.s || ':' || passes || ':' || b), b ROWS UNBOUNDED PRECEDING) AS upto FROM sums JOIN p ON p.s = sums.s),
j AS (SELECT d.*, weight, coalesce(passes, 1) AS passes, upto <= rest AS inside,
  CASE WHEN upto > rest AND upto - t < rest THEN rest - upto + t END AS left_over
  FROM d LEFT JOIN q ON q.s = d.s AND q.b = d.b),
k AS (SELECT *, sum(n) OVER (PARTITION BY s, b ORDER BY md5('mix:' || passes || ':' || coalesce(CAST(doc_id AS VARCHAR), '-')), n
  ROWS UNBOUNDED PRECEDING) AS run FROM j),
c AS (SELECT *, passes + CASE WHEN coalesce(inside, false) OR run <= left_over THEN 1 ELSE 0 END AS copies FROM k)
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, unnest(range(0, CAST(copies AS BIGINT))) AS epoch, b AS block,
  round(weight, 6) AS weight FROM c
"""


@register("op2_mixing", OP2_SQL)
def op2_mixing(spark, sf_dir):
    """All documents mixed so that no source is read more than twice as often as another."""
    r = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), max_repetition=LIMIT)
    return r.select("doc_id", "source", F.col("_n_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"),
                    F.col("_block").alias("block"), F.round("_weight", 6).alias("weight"))
