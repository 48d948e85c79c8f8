"""Two-level running sums.

A running sum over a whole corpus written as one window would put every row
into a single task (or, partitioned by source, put the largest source into a
single task).  Instead rows are cut into range buckets of the ordering key:

1. per (group, bucket) totals - a partial aggregate, tiny output;
2. running sum over the bucket totals (at most groups x buckets rows; joined back
   by (group, bucket), broadcast by Spark where its size allows it);
3. window *inside* each (group, bucket) partition, plus the bucket offset.

The bucket must be monotone in the ordering key (e.g. the first hex digits of
an md5 key, or ``doc_id div width``).  Buckets of an md5 key are uniform, so a
group that holds a third of all rows is still spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hex_bucket(key: Column | str, digits: int) -> Column:
    """Range bucket of a lowercase hex key: its first ``digits`` digits as an int."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def running_sum(df: DataFrame, value: str, order: Sequence[str], bucket: Column,
                by: Sequence[str] = (), out: str = "incl", bucket_offset_max: Column | int | None = None,
                keep_bucket_cols: bool = False) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` within ``by`` ordered by ``order``.

    Null groups are groups and null ordering keys come first; no row is lost.

    ``bucket_offset_max``: when given, rows of buckets whose offset (sum of all
    earlier buckets in the group) is above it are dropped *before* the row-level
    window: a budget cut never needs them, and the window then only sorts the
    prefix of the corpus that can still be admitted.  It may be a column of the
    per-group table (e.g. the group's budget) or a number.
    """
    by = list(by)
    order = list(order)
    # a null ordering key sorts first, so its bucket lies before all others
    b = df.withColumn("_bk", F.coalesce(bucket.cast("long"), F.lit(-1)))
    totals = b.groupBy(*by, "_bk").agg(F.sum(value).alias("_bt"))
    wb = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(totals.schema["_bt"].dataType)
    named = [f"_by{i}" for i in range(len(by))]
    offsets = totals.select(*[F.col(c).alias(n) for c, n in zip(by, named)], F.col("_bk").alias("_bkey"),
                            F.coalesce(F.sum("_bt").over(wb), zero).alias("_bo"))
    # a group may be null; Spark broadcasts the offsets (groups x buckets rows) when their size allows it
    same = F.col("_bk") == F.col("_bkey")
    for c, n in zip(by, named):
        same = same & b[c].eqNullSafe(F.col(n))
    j = b.join(offsets, same).drop("_bkey", *named)
    if bucket_offset_max is not None:
        lim = bucket_offset_max if isinstance(bucket_offset_max, Column) else F.lit(bucket_offset_max)
        j = j.filter(F.col("_bo") <= lim)
    wr = Window.partitionBy(*by, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn(out, F.col("_bo") + F.sum(value).over(wr))
    if not keep_bucket_cols:
        j = j.drop("_bk", "_bo")
    return j


def range_bucket(df: DataFrame, col: str, n_buckets: int = 4096) -> Column:
    """Range bucket of a numeric ordering column: ``n_buckets`` equal-width ranges between its
    minimum and maximum (one scalar aggregate), so the bucket table never grows with the data."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return F.lit(0).cast("long")
    width = max(1, -(-(hi - lo + 1) // n_buckets))
    return F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("long")
