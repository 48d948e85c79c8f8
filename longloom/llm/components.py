"""Distributed connected components: alternating large-star / small-star contraction.

Edges are rows ``(u, v)`` of longs with ``u > v``.  One round rewires every edge to the smallest
neighbour seen from its larger (large-star) and then its smaller end (small-star); the graph
converges to a star forest in a logarithmic number of rounds.  Minima are plain aggregates with
map-side combining, so a hub with a third of all edges costs one row per task; the joins back are
ordinary shuffled joins, which adaptive execution splits when a key is hot.  Every round is
written to the shared checkpoint folder; the driver sees three numbers per round.  The rounds grow with
the logarithm of the longest path: ``MAX_ROUNDS`` is only reached by a defect, and then raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

MAX_ROUNDS = 60


def _star(e: DataFrame, nbr: DataFrame) -> DataFrame:
    """Join every (u, v) of ``nbr`` with the smallest neighbour of u (u itself included)."""
    low = nbr.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return nbr.join(low, "u")


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    j = _star(e, both).filter("v > u")
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(e: DataFrame) -> DataFrame:
    j = _star(e, e)
    to_min = j.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    own = j.select("u", F.col("m").alias("v"))
    return to_min.unionByName(own).distinct()


def _print(e: DataFrame):
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
              F.max(F.col("u"))).first()
    return tuple(r)


def star_forest(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every node that is not the smallest of its component, with that smallest node.

    ``edges`` has two long columns ``u, v`` in any order; loops, repeats and rows with a null end
    are ignored.  An empty table gives an empty forest.
    """
    e = edges.filter("u is not null and v is not null and u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e, "cc-edges")
    seen = _print(e)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            return e
        e = cut_lineage(_small(_large(e)), "cc-round")
        now = _print(e)
        if now == seen:
            return e
        seen = now
    raise RuntimeError("connected components did not converge")
