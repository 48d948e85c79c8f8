"""Readers for the corpus and the evaluation tables (explicit schemas, pruned scans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table_path

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

# Raw corpus row of the original stream: text plus a nested source name.
RAW_DOCUMENT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("meta", T.StructType([T.StructField("redpajama_set_name", T.StringType())])),
])

BENCHMARK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

_SCHEMAS = {"documents": DOCUMENTS, "benchmark": BENCHMARK, "conversations": CONVERSATIONS}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the driver data; known tables are read with their schema."""
    r = spark.read
    if name in _SCHEMAS:
        r = r.schema(_SCHEMAS[name])
    return r.parquet(table_path(sf_dir, name))


def corpus_scan(spark: SparkSession, path: str, fmt: str = "parquet", with_text: bool = False) -> DataFrame:
    """Corpus rows as ``doc_id, source, n_chars`` (+ ``text``).

    Parquet input carries ``doc_id`` and ``source``; ``n_chars`` is taken from the file or, when the
    file has no such column, counted from the text.  JSON lines in the raw form (``text`` +
    ``meta.redpajama_set_name``) are read with a fixed schema and fail fast on malformed lines; their
    ``doc_id`` follows from the content (see :func:`content_ids`), whatever the splits of the scan.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        if "n_chars" not in df.columns:
            df = df.withColumn("n_chars", F.length("text").cast("long"))
    elif fmt == "json":
        raw = spark.read.schema(RAW_DOCUMENT).option("mode", "FAILFAST").json(path)
        df = content_ids(raw.select(F.col("meta.redpajama_set_name").alias("source"), "text",
                                    F.length("text").cast("long").alias("n_chars")))
    else:
        raise ValueError(f"unsupported corpus format {fmt}")
    return df.select("doc_id", "source", "n_chars", *(["text"] if with_text else []))


def content_ids(rows: DataFrame) -> DataFrame:
    """Add ``doc_id``: 60 bits of the md5 of (source, text, occurrence); equal rows are numbered."""
    content = F.md5(F.concat_ws("\x1f", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_content", content)
    again = rows.groupBy("_content").count().filter("count > 1").drop("count")
    once = rows.join(again, "_content", "left_anti").withColumn("_nth", F.lit(1))
    # only repeated rows are numbered, so no other text is sorted
    many = rows.join(again, "_content", "left_semi").withColumn("_nth", F.row_number().over(
        Window.partitionBy("_content").orderBy("n_chars")))
    key = F.substring(F.md5(F.concat_ws(":", "_content", F.col("_nth").cast("string"))), 1, 15)
    return once.unionByName(many).withColumn("doc_id", F.conv(key, 16, 10).cast("long")).drop("_content", "_nth")
