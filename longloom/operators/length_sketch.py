"""Mergeable length distributions: a stored quantile sketch per group.

A value falls into the bucket of its leading ``bits + 1`` binary digits, so a bucket is at most
``2 ** -bits`` of its values wide.  The sketch is the table of bucket counts (at most
``64 * 2 ** bits`` rows a group, however many rows were counted): built with map-side combining,
merged by adding, stored per run and read without rescanning.  The sketch of a whole equals the
merged sketches of its parts exactly; a quantile read from it differs from the exact (nearest rank)
one by at most ``2 ** -bits`` of its value.  :func:`longloom.operators.profile.length_profile` is the
exact form.

Null values are not counted, negative ones count as 0; a null group is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K

BITS = 7


def bucket(value: Column, bits: int = BITS) -> tuple[Column, Column]:
    """Lowest value of the bucket of a non-negative integer, and the bucket's width."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(1 + bits), F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift), width


def sketch(df: DataFrame, value: str, by: str = "source", bits: int = BITS) -> DataFrame:
    """``by, low, width, n, total, vmin, vmax``: the counted buckets of an integer column."""
    v = F.greatest(F.col(value).cast("long"), F.lit(0))
    low, width = bucket(F.col("_v"), bits)
    d = df.filter(F.col(value).isNotNull()).select(F.col(by), v.alias("_v")).select(by, "_v", low.alias("low"), width.alias("width"))
    return d.groupBy(by, "low", "width").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"),
                                             F.min("_v").alias("vmin"), F.max("_v").alias("vmax"))


def merge(*sketches: DataFrame, by: str = "source") -> DataFrame:
    """One sketch of everything that went into several."""
    every = sketches[0]
    for s in sketches[1:]:
        every = every.unionByName(s)
    return every.groupBy(by, "low", "width").agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                                 F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def store(s: DataFrame, path: str, run: str) -> None:
    """Keep a run's sketch under ``path``; the same run again replaces it."""
    s.write.mode("overwrite").parquet(f"{path}/run={run}")


def load(spark: SparkSession, path: str, by: str = "source") -> DataFrame:
    """All stored runs as one sketch."""
    return merge(spark.read.parquet(path).drop("run"), by=by)


def quantiles(s: DataFrame, by: str = "source", percentiles=None) -> DataFrame:
    """``by, n, total, portion, p25 ...``: counts, sums and share are exact, percentiles within the bound.

    A percentile is the middle of the bucket that holds its nearest rank, within the values seen."""
    ps = percentiles or K.PROFILE_PERCENTILES
    up = Window.partitionBy(by).orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    c = s.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    least, most = F.greatest("low", "vmin"), F.least(F.col("low") + (F.col("width") - 1), F.col("vmax"))
    middle = least + F.call_function("shiftright", most - least, F.lit(1))
    g = c.withColumn("middle", middle).groupBy(by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), *[
        F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.struct(F.col("low"), F.col("middle"))))["middle"].alias(f"p{p}")
        for p in ps])
    share = F.col("total") / F.sum("total").over(Window.partitionBy())        # one row a group
    return g.select(by, "n", "total", share.alias("portion"), *[f"p{p}" for p in ps])
