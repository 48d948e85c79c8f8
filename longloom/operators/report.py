"""Reports over needle results: scores, summaries, the depth x length pivot, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scoring import needle_recall


def with_recall(results: DataFrame, expected: str = K.EXPECTED_ANSWER) -> DataFrame:
    """Add ``recall`` (word-set recall of the expected answer; null response -> 0)."""
    return results.withColumn("recall", needle_recall(F.col("model_response"), expected))


def summary(scored: DataFrame, value: str = "recall") -> DataFrame:
    """Mean per (model, depth, length) cell, plus the model's overall mean over all result rows."""
    cells = scored.groupBy("model", "depth_percent", "context_length").agg(F.avg(value).alias("cell_score"))
    overall = scored.groupBy("model").agg(F.avg(value).alias("overall_score"))
    return cells.join(overall, "model")


def heatmap(scored: DataFrame, lengths: list[int], value: str = "recall") -> DataFrame:
    """Pivot: one row per (model, depth), one column per context length (explicit list), cell means."""
    return (scored.groupBy("model", "depth_percent").pivot("context_length", lengths).agg(F.avg(value)))


def beyond_train_len(scored: DataFrame, pretrained_len: int = K.PRETRAINED_LEN) -> DataFrame:
    """Per model: number of distinct lengths and the index of the first length beyond ``pretrained_len``
    in ascending order (the last index when none is beyond)."""
    d = scored.select("model", "context_length").distinct()
    w = Window.partitionBy("model").orderBy("context_length")
    d = d.withColumn("idx", F.row_number().over(w) - 1)
    return d.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_lengths"),
        F.coalesce(F.min(F.when(F.col("context_length") > pretrained_len, F.col("idx"))), F.max("idx"))
        .cast("int").alias("pretrained_idx"))


def resume(cells: DataFrame, results: DataFrame, version: int = K.RESULTS_VERSION) -> DataFrame:
    """Cells still to run: no result with the same model, length, depth and version (missing = 1)."""
    done = results.select("model", "context_length", "depth_percent",
                          F.coalesce(F.col("version"), F.lit(1)).alias("version")).filter(F.col("version") == version)
    todo = cells.withColumn("version", F.lit(version))
    return todo.join(done, ["model", "context_length", "depth_percent", "version"], "left_anti")
