"""Structured Streaming forms of sampling, packing and the sampling counters.

The corpus arrives as a file stream.  Arrival order is (micro-batch, stream
key ``k`` inside the batch).  Budget admission and packing keep their state
in a small versioned table under the shared checkpoint folder, one version
per micro-batch id, and do all per-batch work with distributed DataFrame
operations inside ``foreachBatch``:

* admission state: one row per source (chars used so far) - bounded by the mix;
* packing state: total tokens so far plus the unfinished last chunk (< C + 1
  tokens) - bounded by the chunk size.

Outputs of batch ``b`` go to ``<out>/batch_id=b`` and are overwritten when a
batch is replayed after a failure, so the sinks are idempotent.  A source
that becomes full stops on its own; with ``stop_when_full`` the document that
fills the last source ends the admission as well: the state says which sources
are full, the batch in which the last one fills admits up to that key, later
ones admit nothing and the query ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.tokens import PatternTokenizer
from ..operators import packing as P
from ..operators.prefix import hex_bucket, running_sum
from ..operators.sampling import TIES, SampleSpec, attach_budgets, order_key, with_stream_keys
from ..session import scratch_path
from ..sources.io import SPAN
from ..sources.tables import DOCUMENTS


SHUFFLE = "spark.sql.shuffle.partitions"
# Spark deletes a query's shuffle files when it (or a micro-batch of it) ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _settings(spark: SparkSession, values: dict):
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ------------------------------------------------------------------ sources

# Bytes of a segment's row groups: a file is read by as many tasks as it has of them.
ROW_GROUP = 8 << 20
# Quantiles of a segment's keys from which the ranges of its files are taken.
MARKS = 1000


def range_bounds(marks: list, n: int) -> list:
    """Upper bounds of the first ``n - 1`` of ``n`` ranges with about as many of the sorted ``marks``; no bound comes twice."""
    out, due = [], len(marks) / n
    for j, x in enumerate(marks, 1):
        if len(out) < n - 1 and j >= due and (not out or x > out[-1]):
            out.append(x)
            due += len(marks) / n
    return out


def write_segments(docs: DataFrame, spark: SparkSession, name: str, n_segments: int, key: str = "k",
                   files_per_segment: int = 4, only: list[int] | None = None, path: str | None = None) -> str:
    """Write a table as ``n_segments`` stream segments, in order of ``key`` ranges.

    Segment ``i`` holds the ``i``-th range of the first hex digit of ``key`` in
    exactly ``files_per_segment`` files (range partitions of ``key``); segments
    are written one after the other so file times follow segment order.  Read
    with ``document_stream(files_per_trigger=files_per_segment)`` every
    micro-batch is one segment.  Used to replay a finished table as a stream.
    """
    out = path or scratch_path(spark, name)
    width = 16 / n_segments
    seg = F.floor(hex_bucket(key, 1) / width).cast("int")
    d = docs.withColumn("_seg", seg).withColumn("_at", F.conv(F.substring(key, 1, 13), 16, 10).cast("long"))
    # the ranges of all segments from one pass over the keys: a range partitioning would read every text to sample its key
    steps = [(j + 1) / MARKS for j in range(MARKS)]
    marks = {r["_seg"]: r["m"] for r in d.groupBy("_seg").agg(F.percentile_approx("_at", steps).alias("m")).collect()}
    for i in (only if only is not None else range(n_segments)):
        part = d.filter(F.col("_seg") == i).drop("_seg")
        file = F.lit(0)
        for bound in range_bounds(marks.get(i) or [], files_per_segment):
            file = file + (F.col("_at") > bound).cast("int")
        part = part.repartitionById(files_per_segment, file).drop("_at")
        with _settings(spark, {CLEANUP: True}):
            part.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(out)
    return out


def document_stream(spark: SparkSession, path: str, files_per_trigger: int = 4, schema=DOCUMENTS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _run(stream_df: DataFrame, fn, spark: SparkSession, name: str, mode: str = "append",
         checkpoint: str | None = None, finished=None):
    """Process what is available.  ``finished()`` ends the query before, between two batches."""
    q = (stream_df.writeStream.outputMode(mode).foreachBatch(fn)
         .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-ckpt"))
         .trigger(availableNow=True).start())
    if finished is None:
        q.awaitTermination()
    else:
        while not q.awaitTermination(0.2):
            if finished():
                q.stop()
                break
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def _previous_state(spark: SparkSession, state_dir: str, batch_id: int, schema: str) -> DataFrame:
    """State version ``batch_id - 1`` (empty before the first batch).

    Every batch writes its state before it is committed, and batch ids are consecutive, so the version
    before a batch always exists.  A version that is missing or cannot be read is an error and stops
    the stream: going on from an older one would count documents twice.
    """
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{state_dir}/batch_id={batch_id - 1}")


# ------------------------------------------------------------------ T1: admission

def stream_sample(spark: SparkSession, stream_df: DataFrame, spec: SampleSpec, mix: DataFrame,
                  name: str = "stream_sample", base: str | None = None, stop_when_full: bool = False) -> str:
    """Per-source budget admission over a document stream; returns the output folder.

    Output rows: ``doc_id, source, n_chars, k, offset`` partitioned by batch id.  Pass the
    same ``base`` folder again to resume after a failure or a stop (output, state and stream
    checkpoint live under it); by default a fresh folder is used.  With ``stop_when_full`` nothing is
    admitted after the document that fills the last source of the mix, and the query ends there.
    """
    base = base or scratch_path(spark, name)
    out, state_dir = f"{base}/out", f"{base}/state"
    state_schema = "source string, used long, full boolean"
    n_sources = mix.select("source").distinct().count() if stop_when_full else 0
    done = []

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        prev = _previous_state(spark, state_dir, batch_id, state_schema)
        were_full = prev.filter("full").count() if stop_when_full else 0
        if stop_when_full and were_full == n_sources:
            # the scan is over: the state stays, the batch admits nothing
            prev.coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/batch_id={batch_id}")
            done.append(batch_id)
            return
        last = False
        d = attach_budgets(with_stream_keys(batch, spec), mix, spec)
        # state rows: one per source of the mix (bounded) -> broadcast
        d = d.join(F.broadcast(prev), "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
        d = d.withColumn("v", F.when(F.col("pass"), F.coalesce("n_chars", F.lit(0))).otherwise(F.lit(0)).cast("long"))
        w = running_sum(d, "v", TIES, hex_bucket("k", spec.bucket_digits), by=["source"], out="incl",
                        bucket_offset_max=F.col("bf") - F.col("used"))
        w = w.withColumn("prior", F.col("used") + F.col("incl") - F.col("v"))
        adm = w.filter(F.col("pass") & (F.col("prior") <= F.col("bf"))).select(
            "doc_id", "source", "n_chars", "k", F.col("prior").alias("offset"),
            (F.col("used") + F.col("incl") >= F.col("bc")).alias("fills")).persist()
        held = adm
        filled = adm.filter("fills").groupBy("source").agg(F.min("k").alias("k_full"))
        if stop_when_full:
            now = filled.join(prev.filter("full"), "source", "left_anti").agg(
                F.count(F.lit(1)).alias("n"), F.max("k_full").alias("k")).first()
            if were_full + now.n == n_sources:
                # the last source fills here
                adm, last = adm.filter(F.col("k") <= F.lit(now.k)), True
        adm.drop("fills").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        add = adm.groupBy("source").agg(F.sum("n_chars").alias("add"), F.max("fills").alias("fills"))
        no = F.lit(False)
        new = prev.join(add, "source", "full").select(
            "source", (F.coalesce("used", F.lit(0)) + F.coalesce("add", F.lit(0))).cast("long").alias("used"),
            (F.coalesce("full", no) | F.coalesce("fills", no)).alias("full"))
        new.coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/batch_id={batch_id}")
        held.unpersist()
        if last:
            done.append(batch_id)

    _run(stream_df.select("doc_id", "source", "n_chars"), per_batch, spark, name, checkpoint=f"{base}/checkpoint",
         finished=(lambda: bool(done)) if stop_when_full else None)
    return out


# ------------------------------------------------------------------ T2: packing

def stream_pack(spark: SparkSession, stream_df: DataFrame, chunk_size: int, tokenizer=None,
                name: str = "stream_pack", base: str | None = None) -> str:
    """Pack a document stream into chunks; the unfinished last chunk is carried to the next batch.

    Output rows: ``chunk_id, input_ids, labels, source`` partitioned by batch id.  Pass the
    same ``base`` folder again to resume (see :func:`stream_sample`).
    """
    C = chunk_size
    base = base or scratch_path(spark, name)
    out, state_dir = f"{base}/out", f"{base}/state"
    state_schema = "total long, source string, s long, e long, input_ids array<int>"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        prev = _previous_state(spark, state_dir, batch_id, state_schema).persist()
        row = prev.agg(F.max("total")).first()
        n_prev = row[0] or 0
        # tokenized once per batch: the token total and both offset passes read it
        d = P.with_token_ids(batch.select("source", "k", "text"), tokenizer=tokenizer).persist()
        o = P.token_offsets(d, "n", "k")
        o = o.select("source", (F.col("s") + n_prev).alias("s"), (F.col("e") + n_prev).alias("e"), "input_ids")
        runs = o.unionByName(prev.filter(F.col("s").isNotNull()).select("source", "s", "e", "input_ids")).persist()
        n_new = n_prev + (d.agg(F.sum("n")).first()[0] or 0)
        P.pack_from_offsets(runs, C).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        # carry the region holding the last token (its label does not exist yet)
        if n_new > 0:
            last = (n_new - 1) // C
            tail = runs.filter(F.col("e") > last * C).select(
                "source", F.greatest("s", F.lit(last * C)).alias("s"), "e", "input_ids", F.col("s").alias("s0"))
            tail = tail.select(F.lit(n_new).alias("total"), "source", "s", "e",
                               F.slice("input_ids", (F.col("s") - F.col("s0") + 1).cast("int"),
                                       (F.col("e") - F.col("s")).cast("int")).alias("input_ids"))
        else:
            tail = spark.createDataFrame([], state_schema)
        marker = spark.createDataFrame([(n_new, None, None, None, None)], state_schema)
        # a shuffle of the few rows left over: coalesce(1) would read all runs in one task
        tail.unionByName(marker).repartition(1).write.mode("overwrite").parquet(f"{state_dir}/batch_id={batch_id}")
        runs.unpersist()
        prev.unpersist()
        d.unpersist()

    keyed = stream_df.select("source", "text", order_key(F.col("doc_id")).alias("k"))
    _run(keyed, per_batch, spark, name, checkpoint=f"{base}/checkpoint")
    return out


LANE_CHUNK = T.StructType([
    T.StructField("lane", T.IntegerType()), T.StructField("chunk_id", T.LongType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("labels", T.IntegerType()), T.StructField("source", T.ArrayType(SPAN))])
_LANE_STATE = "cut long, ids binary, spans string"


def lane_of(key: Column, text: Column, lanes: int) -> Column:
    """Lane of a document by a hash of its stream key and text, so an id with many texts fills every lane."""
    h = F.md5(F.concat(key, F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % lanes).cast("int")


LANE_ROWS = 1000


def _pack_lane(chunk_size: int):
    """Cut one lane's documents into chunks; what is left (at most ``chunk_size`` tokens) is the state.

    The tokens of a micro-batch wait in a temporary file; held are their places, in stream order."""
    def run(key, frames, state):
        import json
        import tempfile

        import numpy as np
        import pandas as pd
        cut, raw, spans = state.get if state.exists else (0, b"", "[]")
        held = [np.frombuffer(raw, np.int32)]
        spans = json.loads(spans)                          # [source, tokens] runs of what is held
        n, names = len(held[0]), {}
        columns = ["lane", "chunk_id", "input_ids", "labels", "source"]
        out = []
        with tempfile.TemporaryFile() as file:
            places, end = [], 0
            for rows in frames:
                for k, source, ids in zip(rows["k"], rows["source"], rows["input_ids"]):
                    if ids is None or not len(ids):
                        continue
                    file.write(np.asarray(ids, np.int32).tobytes())
                    places.append((k, end, len(ids), None if source is None else names.setdefault(str(source), str(source))))
                    end += len(ids)
            places.sort(key=lambda x: (not isinstance(x[0], str), x[0]))       # a null key comes last
            for _, start, size, source in places:
                file.seek(4 * start)
                held.append(np.frombuffer(file.read(4 * size), np.int32))
                spans.append([source, size])
                n += size
                if n <= chunk_size:
                    continue
                flat, at = np.concatenate(held), 0
                while n - at > chunk_size:                 # the token after a chunk is its label
                    own, left = [], chunk_size
                    while left:
                        name, size = spans[0]
                        take = min(size, left)
                        begin = chunk_size - left
                        own.append({"source": name, "start": begin, "end": begin + take})
                        left -= take
                        spans[0][1] -= take
                        if not spans[0][1]:
                            spans.pop(0)
                    out.append((key[0], cut, flat[at: at + chunk_size], int(flat[at + chunk_size]), own))
                    at, cut = at + chunk_size, cut + 1
                    if len(out) == LANE_ROWS:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                held, n = [flat[at:]], n - at
        state.update((cut, np.concatenate(held).tobytes(), json.dumps(spans)))
        yield pd.DataFrame(out, columns=columns)
    return run


def _as_bytes(run):
    """``run`` with its chunks' tokens as bytes: on an array column Spark makes every item a Python object."""
    def packed(key, frames, state):
        for rows in run(key, frames, state):
            yield rows.assign(input_ids=[ids.tobytes() for ids in rows["input_ids"]])
    return packed


def _from_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of :func:`_as_bytes` with their ids as arrays again."""
    import numpy as np
    for rows in batches:
        i = rows.schema.get_field_index("input_ids")
        raw = rows.column(i).to_pylist()
        at = np.cumsum([0, *map(len, raw)]) // 4
        ids = pa.array(np.frombuffer(b"".join(raw), np.int32))
        yield rows.set_column(i, "input_ids", pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids))


def _lane_partitions(spark: SparkSession, lanes: int) -> int:
    """The least number of partitions, up to the session's, in which every lane has one of its own; each
    costs a state store and Python workers a micro-batch, whether it has rows or not."""
    most = int(spark.conf.get(SHUFFLE))
    at = [h for h, in spark.range(lanes).select(F.hash(F.col("id").cast("int"))).collect()]
    return next((n for n in range(lanes, most) if len({h % n for h in at}) == lanes), most)


def stream_pack_lanes(spark: SparkSession, stream_df: DataFrame, chunk_size: int, lanes: int, tokenizer=None,
                      name: str = "stream_pack_lanes", base: str | None = None) -> str:
    """Pack a document stream in ``lanes`` independent lanes with Spark's keyed state.

    Every lane is one endless token sequence (micro-batch, then stream key) with chunk numbers of its
    own, ``(N - 1) div chunk_size`` chunks of ``N`` tokens.  Its state is the unfinished rest, at most
    ``chunk_size`` tokens, in Spark's state store; a task works on one lane's share of a micro-batch, which
    ``maxFilesPerTrigger`` bounds, and holds the places of its documents, not their tokens.  It only cuts
    bytes; tokens are made before it and chunks written after it by all tasks.  Output rows
    (``lane, chunk_id, input_ids, labels, source``) go to a Parquet file sink, exactly once; pass the same
    ``base`` again to resume.
    """
    base = base or scratch_path(spark, name)
    d = stream_df.select("source", "text", order_key(F.col("doc_id")).alias("k"))
    d = P.with_token_ids(d.withColumn("lane", lane_of(F.col("k"), F.col("text"), lanes)), tokenizer=tokenizer or PatternTokenizer())
    raw = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "input_ids" else f for f in LANE_CHUNK])
    packed = d.select("lane", "k", "source", "input_ids").groupBy("lane").applyInPandasWithState(
        _as_bytes(_pack_lane(chunk_size)), raw, _LANE_STATE, "append", GroupStateTimeout.NoTimeout)
    # a lane is packed in one task; its chunks, whose arrays take longest to write, are dealt to all
    tasks = spark.sparkContext.defaultParallelism
    packed = packed.withColumn("_to", F.pmod(F.col("chunk_id") + F.col("lane"), F.lit(tasks)).cast("int"))
    packed = packed.repartitionById(tasks, "_to").drop("_to")
    writer = (packed.mapInArrow(_from_bytes, LANE_CHUNK).writeStream.outputMode("append").format("parquet")
              .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True))
    # a query keeps the settings that it starts with
    with _settings(spark, {SHUFFLE: _lane_partitions(spark, lanes), CLEANUP: True}):
        q = writer.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return f"{base}/out"


# ------------------------------------------------------------------ T3: counters

def stream_counters(spark: SparkSession, stream_df: DataFrame, spec: SampleSpec, name: str = "stream_counters",
                    base: str | None = None) -> str:
    """Running per-source counters (rows seen, rows passing the coin, characters) with
    Spark's streaming aggregation; the complete table is rewritten after every batch.
    Pass the same ``base`` folder again to resume."""
    base = base or scratch_path(spark, name)
    out = f"{base}/out"
    d = with_stream_keys(stream_df.select("doc_id", "source", "n_chars"), spec)
    agg = d.groupBy("source").agg(F.count(F.lit(1)).alias("scanned"), F.count_if("pass").alias("passed_coin"),
                                  F.sum("n_chars").alias("n_chars"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    _run(agg, per_batch, spark, name, mode="complete", checkpoint=f"{base}/checkpoint")
    return out
