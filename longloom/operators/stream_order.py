"""The corpus in stream order, and a scan of it that ends when the budgets are full.

:func:`write_stream_order` writes a corpus once as range partitions of its stream key, each sorted and
in one file, with a manifest (key range, rows and characters of every part, and what lies before it).
One-pass readers take the parts in order and need no sort; a document's position is the rows before
its part plus its place in the file.

:func:`sample_until_full` samples without reading the whole corpus: the manifest tells which parts hold
the characters that the budgets need; these are sampled, and while a source is still unfilled at the
end of them more parts are taken in (partition pruning: other parts are not opened).  The rows are
those of :func:`longloom.operators.sampling.sample` over everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import scratch_path
from . import sampling
from .sampling import SampleResult, SampleSpec, order_key


@dataclass(frozen=True)
class StreamTable:
    """A written corpus: ``<path>/data/part=<n>/`` and ``<path>/manifest``.

    ``schema`` (taken from the files when not given) is only needed for a corpus without rows."""

    path: str
    schema: T.StructType | None = None

    def _data(self, spark: SparkSession) -> DataFrame:
        return (spark.read.schema(self.schema) if self.schema else spark.read).parquet(f"{self.path}/data")

    def documents(self, spark: SparkSession, last_part: int | None = None) -> DataFrame:
        """Rows with their key ``k`` and ``part``; with ``last_part`` only the parts up to it."""
        d = self._data(spark)
        return d if last_part is None else d.filter(F.col("part") <= F.lit(last_part))

    def manifest(self, spark: SparkSession) -> DataFrame:
        """``part, first_k, last_k, rows, chars, rows_before, chars_before``, one row a part."""
        return spark.read.parquet(f"{self.path}/manifest")

    def positions(self, spark: SparkSession) -> DataFrame:
        """``doc_id, k, pos``: the 0-based position of every document, without sorting."""
        d = self._data(spark).select("doc_id", "k", "part", F.col("_metadata.row_index").alias("_row"))
        m = self.manifest(spark).select("part", "rows_before")
        return d.join(m, "part").select("doc_id", "k", (F.col("rows_before") + F.col("_row")).alias("pos"))


def write_stream_order(docs: DataFrame, path: str | None = None, n_parts: int | None = None,
                       seed: int = K.ORDER_SEED) -> StreamTable:
    """Write ``docs`` (``doc_id, n_chars`` and any other columns) in stream order.

    Rows of one doc_id (null is an id) share a key and are spread by a hash of the row, so an id with
    very many rows fills several parts.  The manifest is written last: a table without one is unfinished.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "stream_order")
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.withColumn("_h", F.xxhash64(*docs.columns)).withColumn("k", order_key(F.col("doc_id"), seed))
    d = d.repartitionByRange(n, "k", "_h").withColumn("part", F.spark_partition_id())
    # the order asked for starts with the partition column, so the writer does not sort again
    d = d.sortWithinPartitions("part", "k", "_h").drop("_h")
    d.write.mode("overwrite").partitionBy("part").parquet(f"{path}/data")
    table = StreamTable(path, d.schema)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row a part
    m = table.documents(spark).groupBy("part").agg(
        F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.coalesce("n_chars", F.lit(0))).cast("long").alias("chars"))
    m = m.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "chars")])
    m.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return table


@dataclass
class EarlyScan:
    result: SampleResult
    last_part: int          # parts up to this one were read
    rows_read: int
    rows_total: int


def sample_until_full(spark: SparkSession, table: StreamTable, spec: SampleSpec, mix: DataFrame | None = None,
                      head_start: float = 1.5) -> EarlyScan:
    """Sample the shortest prefix of parts that fills every budget.

    The first prefix holds ``head_start`` times the characters of the budgets, each further one twice
    as many; the cut is certain when the stop key lies before the last key read, or nothing is left.
    """
    m = table.manifest(spark)
    end = m.agg(F.max("part").alias("part"), F.sum("rows").alias("rows")).first()
    if end.part is None:
        return EarlyScan(sampling.sample(table.documents(spark), spec, mix), -1, 0, 0)
    need = spec.total_tokens * K.CHARS_PER_TOKEN * head_start
    last = -1
    while True:
        reach = m.filter(F.col("chars_before") < F.lit(float(need))).agg(F.max("part")).first()[0]
        last = min(max(reach, last + 1), end.part)
        at = m.filter(F.col("part") <= last).agg(F.max("last_k").alias("k"), F.sum("rows").alias("rows")).first()
        res = sampling.sample(table.documents(spark, last), spec, mix)
        if last == end.part or (res.stop_key is not None and res.stop_key < at.k):
            return EarlyScan(res, last, at.rows, end.rows)
        need *= 2
