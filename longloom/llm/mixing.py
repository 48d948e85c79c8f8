"""Mixing sources to target weights by temperature (DataFrame functions only).

**Weights.**  A source with token share ``p`` gets a weight proportional to ``p ** a``.  The exponent is
bisected in [0, 1]: the smallest ``a`` whose largest repetition stays within ``max_repetition`` and
whose weights have at most the entropy ``target_entropy`` (nats); ``a = 1`` keeps the natural mix, 0
makes all sources equal.  Without a ``budget`` the token budget is the least one at which no source is
cut: the least repeated source is read exactly once and nothing is dropped.  Up to ``ROW_SOURCES`` sources
are weighed in one row; of more, every step evaluates a grid of exponents by aggregates over the sources.
Weights from ``ROUND_FROM`` on have ``DIGITS`` decimals, smaller ones are doubles.

**Realisation.**  A source's budget is ``weight * budget`` tokens: whole passes over the source, then a
part of one.  Documents hash into blocks; the blocks of the partial pass are taken in the order of a
seeded permutation until the budget is met.  The one block where it ends is cut into ranges of its
order by another aggregate, and only the documents of the range of the cut (about one in 4,096 of the
block) are ordered one by one.  Counting needs one aggregate (sources x blocks).  Up to ``ROW_SOURCES`` sources it is
broadcast and no texts are shuffled, apart from those of the last block of each source; beyond, Spark
joins it by its size.  A source with a third of all rows is spread like any other.

Edge cases.  Null sources form a source of their own.  Tokens are white-space words; documents without
tokens, and sources of only such, are read once.  Repeated rows are separate rows with one order key.
Ties of the key are ordered by token count.  Extra columns pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, free_name, let, ws_words

BLOCK_DIGITS = 2                 # hex digits of a block: 256 blocks a source
RANGE_DIGITS = 3                 # hex digits of a range: 4,096 ranges of the block in which the budget ends
ROW_SOURCES = 2_000
STEPS, DIGITS = 60, 9
ROUND_FROM = 1e-4
GRID = 32                        # a grid step halves the span five times


def _key(seed: str, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _weights_at(tokens: Column, total: Column, exponent) -> Column:
    raw = F.transform(tokens, lambda t: F.pow(t / total, exponent))
    return let(raw, lambda r: F.transform(r, lambda x: x / _sum(r)))


def _repetition(tokens: Column, weights: Column, budget) -> Column:
    """Passes over the most repeated source; without a budget the least repeated is read once."""
    rate = F.transform(tokens, lambda t, i: F.get(weights, i) / t)
    if budget is not None:
        return F.array_max(rate) * budget
    return let(rate, lambda r: F.array_max(r) / F.array_min(r))


def _entropy(weights: Column) -> Column:
    return -_sum(F.transform(weights, lambda w: w * F.ln(w)))


def _rounded(weight: Column) -> Column:
    return F.when(weight >= ROUND_FROM, F.round(weight, DIGITS)).otherwise(weight)


def _many_weights(totals: DataFrame, max_repetition: float | None, target_entropy: float | None,
                  budget: int | None) -> DataFrame:
    """:func:`source_weights` for any number of sources; the driver sees one row for each exponent of a grid."""
    totals = cut_lineage(totals.select("s", "t"), "mix-totals")
    ends = totals.agg(F.sum("t").alias("total"), F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    total = float(ends.total)
    p = F.col("t") / F.lit(total)

    def sums(exponents):
        """Per exponent the sums of ``p ** a`` and of ``p ** a * ln p``."""
        x = F.pow(p, F.col("a"))
        grid = totals.select("t", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        found = grid.groupBy("a").agg(F.sum(x).alias("z"), F.sum(x * F.ln(p)).alias("l")).collect()
        return {r.a: r for r in found}

    def fits(r) -> bool:
        # passes fall with the size of a source
        high, low = ((t / total) ** r.a / r.z / t for t in (ends.lo, ends.hi))
        if max_repetition is not None and not (high * budget if budget is not None else high / low) <= max_repetition:
            return False
        return target_entropy is None or math.log(r.z) - r.a * r.l / r.z <= target_entropy
    if fits(sums([0.0])[0.0]):
        exponent = 0.0
    else:
        lo, hi = 0.0, 1.0
        for _ in range(-(-STEPS // int(math.log2(GRID)))):
            grid = sorted({lo + (hi - lo) * k / GRID for k in range(1, GRID)} - {lo, hi})
            if not grid:                                          # neighbouring doubles
                break
            found = sums(grid)
            hi = next((a for a in grid if fits(found[a])), hi)
            lo = max([lo, *(a for a in grid if a < hi)])
        exponent = hi
    z = sums([exponent])[exponent].z
    w = totals.select("s", "t", F.lit(exponent).alias("exponent"), _rounded(F.pow(p, F.lit(exponent)) / F.lit(z)).alias("weight"))
    if budget is None:
        budget = w.agg(F.max(F.ceil(F.col("t") / F.col("weight")).cast("long")).alias("b")).first().b
    return w.withColumn("total_budget", F.lit(budget).cast("long"))


def source_weights(totals: DataFrame, max_repetition: float | None, target_entropy: float | None,
                   budget: int | None) -> DataFrame:
    """``s, t, exponent, weight, total_budget`` from ``s, t`` (tokens of every source, all above 0)."""
    one = totals.agg(F.sort_array(F.collect_list(F.struct("s", "t"))).alias("st"))
    one = one.withColumn("ts", F.transform("st", lambda x: x["t"].cast("double"))).withColumn("total", _sum(F.col("ts")))

    def fits(a):
        def both(w):
            ok = F.lit(True)
            if max_repetition is not None:
                ok = ok & (_repetition(F.col("ts"), w, budget) <= max_repetition)
            if target_entropy is not None:
                ok = ok & (_entropy(w) <= target_entropy)
            return ok
        return let(_weights_at(F.col("ts"), F.col("total"), a), both)
    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
        lambda s, _: let((s["lo"] + s["hi"]) / 2, lambda m: let(fits(m), lambda ok: F.struct(
            F.when(ok, s["lo"]).otherwise(m).alias("lo"), F.when(ok, m).otherwise(s["hi"]).alias("hi")))))
    one = one.withColumn("exponent", F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(span["hi"]))
    one = one.withColumn("w", F.transform(_weights_at(F.col("ts"), F.col("total"), F.col("exponent")),
                                          _rounded))
    least = F.array_max(F.transform("ts", lambda t, i: F.ceil(t / F.get("w", i)).cast("long")))
    one = one.withColumn("total_budget", F.lit(budget).cast("long") if budget is not None else least)
    return one.select("exponent", "total_budget", F.posexplode("st").alias("i", "x"), "w").select(
        F.col("x.s").alias("s"), F.col("x.t").alias("t"), "exponent", F.get("w", F.col("i")).alias("weight"), "total_budget")


def mix(docs: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None,
        budget: int | None = None, seed: str = "mix") -> DataFrame:
    """Rows of ``docs`` (all columns), each as often as the mix reads it, with ``_epoch`` (0, 1 ...),
    ``_block`` (its block), ``_n_tokens``, ``_weight`` (of its source) and ``_exponent``.  A column of
    such a name passes through, the mix's own then gets a further underscore."""
    n_tokens = F.size(ws_words(F.col("r.text"))).cast("long")
    block = F.substring(_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 1, BLOCK_DIGITS)
    # the caller's columns travel as one, so that no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("r"), _source().alias("_s"), block.alias("_block"))
    sums = rows.withColumn("_n_tokens", n_tokens).groupBy("_s", "_block").agg(F.sum("_n_tokens").alias("t"))
    sums = cut_lineage(sums.withColumnRenamed("_s", "s").withColumnRenamed("_block", "b"), "mix-blocks")
    totals = sums.groupBy("s").agg(F.sum("t").alias("t")).filter("t > 0")
    few = totals.count() <= ROW_SOURCES
    w = (source_weights if few else _many_weights)(totals, max_repetition, target_entropy, budget)
    w = w.withColumn("own", F.floor(F.col("weight") * F.col("total_budget")).cast("long"))
    w = w.withColumn("own", F.when((F.col("own") < F.col("t")) & (F.col("own") + F.lit(1) >= F.col("t")), F.col("t"))
                     .otherwise(F.col("own")))                     # the source read once loses nothing to rounding
    w = w.select("s", "exponent", "weight", F.expr("own div t").alias("passes"), F.expr("own % t").alias("rest"))
    # the order of the blocks in the partial pass, and where the budget ends
    order = Window.partitionBy("s").orderBy(_key(seed, F.col("s"), F.col("passes").cast("string"), F.col("b")), "b")
    plan = sums.join(w, "s").withColumn("upto", F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.col("upto") <= F.col("rest")
    plan = plan.select(
        F.col("s").alias("_s"), F.col("b").alias("_block"), F.col("weight").alias("_weight"),
        F.col("exponent").alias("_exponent"), (F.col("passes") + inside.cast("long")).alias("_copies"), "passes",
        F.when(~inside & (F.col("upto") - F.col("t") < F.col("rest")), F.col("rest") - F.col("upto") + F.col("t")).alias("_left"))
    plan = cut_lineage(plan, "mix-plan")                           # sources x blocks rows
    j = rows.join(F.broadcast(plan) if few else plan, ["_s", "_block"], "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    whole = j.filter("_left is null").withColumn("_n_tokens", n_tokens)
    part = j.filter("_left is not null").withColumn("_n_tokens", n_tokens).withColumn(
        "_k", _key(seed, F.col("passes").cast("string"), F.coalesce(F.col("r.doc_id").cast("string"), F.lit("-"))))
    # the block in which the budget ends, cut in ranges of its order: only the range of the cut is sorted
    part = part.withColumn("_range", F.substring("_k", 1, RANGE_DIGITS))
    keys = ["_s", "_block", "_range"]
    upto = Window.partitionBy("_s", "_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = part.groupBy(*keys).agg(F.sum("_n_tokens").alias("_t"))
    ranges = cut_lineage(ranges.withColumn("_before", F.sum("_t").over(upto) - F.col("_t")), "mix-ranges")
    part = part.join(ranges, keys)                                 # sources x ranges rows
    end = F.col("_before") + F.col("_t")
    here = (F.col("_before") <= F.col("_left")) & (end > F.col("_left"))
    last = Window.partitionBy(*keys).orderBy("_k", "_n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = part.filter(here).withColumn("_upto", F.col("_before") + F.sum("_n_tokens").over(last))
    part = part.filter(~here).withColumn("_upto", end).unionByName(cut).withColumn(
        "_copies", F.col("_copies") + (F.col("_upto") <= F.col("_left")).cast("long"))
    part = part.drop("_k", "_upto", "_range", "_t", "_before")
    out = whole.unionByName(part).filter("_copies > 0")
    out = out.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    own = ("_epoch", "_block", "_n_tokens", "_weight", "_exponent")
    return out.select("r.*", *[F.col(c).alias(free_name(docs, c)) for c in own])
