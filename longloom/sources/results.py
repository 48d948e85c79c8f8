"""Results of grid cells: an idempotent sink, and a scan that reads each file once.

**Sink.**  A cell (model, context length, depth) is a partition of the results folder.  Writing a cell
again replaces it, whatever run wrote it, so a run that died half way is repeated or continued
(:func:`longloom.operators.report.resume` on what :func:`read_cells` finds).

**Scan.**  :func:`scan_results` reads the files of a folder that are new or changed since the last scan,
known by path, modification time and length in a ledger of its own.  What cannot be read goes to a
quarantine table with its file and reason instead of ending the job.  Results, quarantine and then the
ledger entry are written under the number of the scan, so a scan that died is repeated whole.  A file
that changed replaces what it gave before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import NEEDLE_RESULT

CELL = ["model", "context_length", "depth_percent"]
_FILES = "path string, modified timestamp, length long, scan long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# ------------------------------------------------------------------ sink

def upsert_cells(results: DataFrame, path: str) -> None:
    """Write whole cells; those that are there already are replaced, the others stay."""
    (results.repartition(*CELL).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*CELL).parquet(path))


def read_cells(spark: SparkSession, path: str, schema: T.StructType = NEEDLE_RESULT) -> DataFrame:
    """All results written so far (none when nothing was written yet)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# ------------------------------------------------------------------ scan

def _ledger(spark: SparkSession, ledger: str, table: str, schema) -> DataFrame:
    path = f"{ledger}/{table}"
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _result_schema(schema: T.StructType) -> T.StructType:
    own = [f for f in schema.fields if f.name not in ("path", "scan")]
    return T.StructType([T.StructField("path", T.StringType()), T.StructField("scan", T.LongType()), *own])


def _field(name: str):
    return lambda r: r[name]


def scan_results(spark: SparkSession, folder: str, ledger: str, schema: T.StructType = NEEDLE_RESULT,
                 required=tuple(CELL), whole_files: bool = True) -> int:
    """Read what is new in ``folder`` into ``ledger``; returns the number of the scan.

    With ``whole_files`` a file is one JSON document (an object or an array of objects), else every line
    is one.  A document that is no JSON or lacks a ``required`` field goes to the quarantine.
    """
    seen = _ledger(spark, ledger, "files", _FILES)
    state = seen.agg(F.max("scan").alias("scan"), F.max("modified").alias("modified")).first()
    scan = 0 if state.scan is None else state.scan + 1
    reader = spark.read.option("recursiveFileLookup", "true")
    if state.modified is not None:
        # older files were seen; those of the last second are told apart by the ledger
        mark = seen.agg(F.date_format(F.max("modified") - F.expr("interval 1 second"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
        reader = reader.option("modifiedAfter", mark)
    meta = F.col("_metadata")
    rows = reader.text(folder, wholetext=whole_files).select(meta["file_path"].alias("path"), meta["file_modification_time"].alias("modified"),
                                      meta["file_size"].alias("length"), "value")
    rows = rows.join(seen.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")
    rows = rows.withColumn("parsed", F.from_json("value", T.ArrayType(schema)))
    lacking = F.lit(False)
    for name in required:
        lacking = lacking | F.exists(F.transform("parsed", _field(name)), lambda v: v.isNull())
    bad = F.when(F.col("parsed").isNull() | (F.size("parsed") == 0), F.lit("no JSON document")).when(
        lacking, F.lit("a required field is missing"))
    rows = rows.withColumn("reason", bad)
    good = rows.filter("reason is null").select("path", F.lit(scan).cast("long").alias("scan"), F.explode("parsed").alias("r"))
    own = [f.name for f in _result_schema(schema).fields[2:]]
    good.select("path", "scan", *[F.col("r")[c].alias(c) for c in own]).write.mode("overwrite").parquet(f"{ledger}/results/scan_id={scan}")
    rows.filter("reason is not null").select("path", F.lit(scan).cast("long").alias("scan"), "reason", "value").write.mode(
        "overwrite").parquet(f"{ledger}/quarantine/scan_id={scan}")
    files = rows.select("path", "modified", "length", F.lit(scan).cast("long").alias("scan")).distinct()
    files.write.mode("overwrite").parquet(f"{ledger}/files/scan_id={scan}")
    return scan


def _latest(spark: SparkSession, ledger: str, rows: DataFrame) -> DataFrame:
    last = _ledger(spark, ledger, "files", _FILES).groupBy("path").agg(F.max("scan").alias("scan"))
    return rows.join(last, ["path", "scan"], "left_semi")


def current_results(spark: SparkSession, ledger: str, schema: T.StructType = NEEDLE_RESULT) -> DataFrame:
    """Results of every file as it was last read, with its ``path``."""
    return _latest(spark, ledger, _ledger(spark, ledger, "results", _result_schema(schema))).drop("scan")


def quarantine(spark: SparkSession, ledger: str) -> DataFrame:
    """``path, reason, value`` of what could not be read, of every file as it was last read."""
    q = _ledger(spark, ledger, "quarantine", "path string, scan long, reason string, value string")
    return _latest(spark, ledger, q).drop("scan")
