"""Shared pieces of the operators: table access, written lineage cuts, native word splitting."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path, table_path

__all__ = ["cut_lineage", "drop_table", "release", "scratch_path", "read", "doc_texts", "row_key", "free_name", "ws_words", "let"]

# the six ASCII white-space characters 0x20 and 0x09-0x0D
WS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator on documents needs; extra columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key() -> Column:
    """What a verdict on a row is joined back by: its doc_id (null is an id of its own) and the
    128-bit fingerprint of its text.  Only repeated rows share a key."""
    text = F.md5(F.col("text").cast("string"))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")),
                       F.coalesce(text, F.lit("-")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ws_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array (null or blank text: empty array)."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t\\n\\x0B\\f\\r]+"))


def let(value: Column, body) -> Column:
    """Bind ``value`` once per row (Catalyst does not share sub-expressions inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def drop_table(df: DataFrame) -> None:
    """Delete the written lineage cut that ``df`` reads, once nothing lazy refers to it any more."""
    files = df.inputFiles()
    if not files:
        return
    folder = files[0].rsplit("/", 1)[0]
    if "/tables/" not in folder:
        raise ValueError(f"not a lineage cut: {folder}")
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.  Its cleaner waits
    for the driver's garbage collection, which a job of many written steps may not reach in time."""
    gc.collect()
    spark._jvm.System.gc()
