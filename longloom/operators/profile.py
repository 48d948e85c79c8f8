"""Length distributions per source (percentiles and share of all tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def length_profile(df: DataFrame, value: str, by: str = "source", percentiles=None) -> DataFrame:
    """Per group: count, sum, share of the grand total and the percentiles of ``value``.

    Percentiles are exact with linear interpolation (numpy's default) at any size: lengths take few
    values, so rows are counted per (group, value) with map-side combining and the percentiles are
    weighted by these counts.  Percentile columns are named ``p25``, ``p50`` ... ``p100``.
    """
    ps = percentiles or K.PROFILE_PERCENTILES
    at = F.array(*[F.lit(p / 100.0) for p in ps])
    counted = df.groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    agg = counted.groupBy(by).agg(F.sum("_c").alias("n"), F.sum(F.col("_v") * F.col("_c")).alias("total"),
                                  F.percentile(F.col("_v"), at, F.col("_c")).alias("_p"))
    # grand total over the per-group rows (one row per group, never per document)
    share = F.col("total") / F.sum("total").over(Window.partitionBy())
    cols = [F.col(by), F.col("n"), F.col("total"), share.alias("portion")]
    cols += [F.col("_p")[i].alias(f"p{p}") for i, p in enumerate(ps)]
    return agg.select(*cols)


def doc_length_profile(docs: DataFrame) -> DataFrame:
    """Original distribution: estimated tokens per document (``n_chars / 3.68``)."""
    d = docs.select("source", (F.col("n_chars") / F.lit(K.CHARS_PER_TOKEN)).alias("est_tokens"))
    return length_profile(d, "est_tokens")
