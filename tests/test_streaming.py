import pytest
from pyspark.sql import functions as F

from longloom.operators import packing, sampling
from longloom.operators.sampling import order_key
from longloom.plans import fixtures as FX
from longloom.streaming import jobs as J


def test_stream_pack_equals_batch(spark, docs_small):
    seg = J.write_segments(docs_small.withColumn("k", order_key(F.col("doc_id"))), spark, "t_stream", 4)
    out = J.stream_pack(spark, J.document_stream(spark, seg), 128)
    s = spark.read.parquet(out)
    d = packing.with_token_ids(docs_small.select("source", "text", order_key(F.col("doc_id")).alias("k")))
    b = packing.pack_chunks(d, 128)
    n = d.select(F.sum(F.size("input_ids"))).first()[0]
    assert s.count() == b.count() == (n - 1) // 128
    assert s.filter(F.size("input_ids") != 128).count() == 0
    digest = lambda df: sorted((r.chunk_id, r.labels, tuple(r.input_ids)) for r in df.collect())
    # segments arrive in key order, so arrival order equals the batch order
    assert digest(s.drop("batch_id")) == digest(b)


def test_stream_sample_within_budget(spark, docs_mid):
    seg = J.write_segments(docs_mid.withColumn("k", order_key(F.col("doc_id"))), spark, "t_stream2", 4)
    mix = sampling.mix_frame(spark, FX.MIX_TEST)
    out = J.stream_sample(spark, J.document_stream(spark, seg), FX.SPEC_PER_SOURCE_LARGE, mix)
    got = spark.read.parquet(out)
    b = sampling.budgets(mix, FX.SPEC_PER_SOURCE_LARGE).collect()
    used = {r.source: (r.used, r.mx) for r in got.groupBy("source").agg(F.sum("n_chars").alias("used"),
                                                                         F.max("n_chars").alias("mx")).collect()}
    for r in b:
        if r.source in used:
            u, mx = used[r.source]
            assert u <= r.bf + mx  # within budget plus one document
    # without the global stop the stream admits what a scan with far larger stop budgets would:
    # every source is filled on its own, up to the document that passes its budget
    keyed = sampling.attach_budgets(sampling.with_stream_keys(docs_mid, FX.SPEC_PER_SOURCE_LARGE), mix, FX.SPEC_PER_SOURCE_LARGE)
    want, used = set(), {}
    for r in sorted(keyed.select("doc_id", "source", "n_chars", "k", "pass", "bf").collect(), key=lambda r: r.k):
        if r["pass"] and used.get(r.source, 0) <= r.bf:
            want.add(r.doc_id)
            used[r.source] = used.get(r.source, 0) + r.n_chars
    assert {r.doc_id for r in got.select("doc_id").collect()} == want


def test_missing_state_stops_the_stream(spark, docs_mid):
    from longloom.session import scratch_path
    keyed = docs_mid.withColumn("k", order_key(F.col("doc_id")))
    mix, spec = sampling.mix_frame(spark, FX.MIX_TEST), FX.SPEC_PER_SOURCE_LARGE
    src, base = scratch_path(spark, "t_lost_src"), scratch_path(spark, "t_lost")
    J.write_segments(keyed, spark, "x", 4, only=[0, 1], path=src)
    J.stream_sample(spark, J.document_stream(spark, src), spec, mix, base=base)
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state/batch_id=1")
    state.getFileSystem(spark._jsc.hadoopConfiguration()).delete(state, True)
    J.write_segments(keyed, spark, "x", 4, only=[2, 3], path=src)
    with pytest.raises(Exception, match="batch_id=1"):
        J.stream_sample(spark, J.document_stream(spark, src), spec, mix, base=base)


def test_stream_counters(spark, docs_small):
    seg = J.write_segments(docs_small.withColumn("k", order_key(F.col("doc_id"))), spark, "t_stream3", 2)
    out = J.stream_counters(spark, J.document_stream(spark, seg), FX.SPEC_PER_SOURCE)
    got = {r.source: r.scanned for r in spark.read.parquet(out).collect()}
    want = {r.source: r["count"] for r in docs_small.groupBy("source").count().collect()}
    assert got == want


def test_stream_resumes_from_its_folder(spark, docs_mid):
    from longloom.session import scratch_path
    keyed = docs_mid.withColumn("k", order_key(F.col("doc_id")))
    mix = sampling.mix_frame(spark, FX.MIX_TEST)
    spec = FX.SPEC_PER_SOURCE_LARGE
    src = scratch_path(spark, "t_resume_src")
    base = scratch_path(spark, "t_resume")
    J.write_segments(keyed, spark, "x", 4, only=[0, 1], path=src)
    J.stream_sample(spark, J.document_stream(spark, src), spec, mix, base=base)   # stops after 2 batches
    J.write_segments(keyed, spark, "x", 4, only=[2, 3], path=src)
    out = J.stream_sample(spark, J.document_stream(spark, src), spec, mix, base=base)  # resumes
    once = J.stream_sample(spark, J.document_stream(spark, J.write_segments(keyed, spark, "t_once", 4)), spec, mix)
    key = lambda p: sorted((r.doc_id, r.offset) for r in spark.read.parquet(p).collect())
    assert key(out) == key(once)
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 4


def test_global_stop_equals_the_batch_form_also_over_a_restart(spark, docs_mid):
    from longloom.session import scratch_path
    keyed = docs_mid.withColumn("k", order_key(F.col("doc_id")))
    mix, spec = sampling.mix_frame(spark, FX.MIX_TEST), FX.SPEC_PER_SOURCE
    want = sorted(map(tuple, sampling.sample(docs_mid, spec, mix).admitted.collect()))
    src, base = scratch_path(spark, "t_stop_src"), scratch_path(spark, "t_stop")
    J.write_segments(keyed, spark, "x", 4, only=[0], path=src)
    out = J.stream_sample(spark, J.document_stream(spark, src), spec, mix, base=base, stop_when_full=True)
    assert spark.read.parquet(out).count() < len(want)
    J.write_segments(keyed, spark, "x", 4, only=[1, 2, 3], path=src)
    J.stream_sample(spark, J.document_stream(spark, src), spec, mix, base=base, stop_when_full=True)
    cols = ["doc_id", "source", "n_chars", "k", "offset"]
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == want
    # a stopped scan stays stopped
    J.stream_sample(spark, J.document_stream(spark, src), spec, mix, base=base, stop_when_full=True)
    assert sorted(map(tuple, spark.read.parquet(out).select(*cols).collect())) == want


def test_lanes_over_a_restart(spark, docs_mid):
    from longloom.session import scratch_path
    lanes, size = 3, 256
    keyed = docs_mid.withColumn("k", order_key(F.col("doc_id"))).withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.col("source")))
    src, base, once = scratch_path(spark, "t_lane_src"), scratch_path(spark, "t_lane"), scratch_path(spark, "t_lane_once")
    J.write_segments(keyed, spark, "x", 4, only=[0, 1], path=src)
    out = J.stream_pack_lanes(spark, J.document_stream(spark, src), size, lanes, base=base)
    J.write_segments(keyed, spark, "x", 4, only=[2, 3], path=src)
    J.stream_pack_lanes(spark, J.document_stream(spark, src), size, lanes, base=base)
    J.stream_pack_lanes(spark, J.document_stream(spark, src), size, lanes, base=once)
    rows = spark.read.parquet(out).collect()
    key = lambda r: (r.lane, r.chunk_id, tuple(r.input_ids), r.labels, tuple(map(tuple, r.source)))
    assert sorted(map(key, rows), key=str) == sorted(map(key, spark.read.parquet(f"{once}/out").collect()), key=str)
    d = packing.with_token_ids(keyed.select("source", "k", "text", J.lane_of(F.col("k"), F.col("text"), lanes).alias("lane")))
    total = {r.lane: r.n for r in d.groupBy("lane").agg(F.sum("n").alias("n")).collect()}
    tokens = {lane: [t for r in sorted(d.filter(F.col("lane") == lane).collect(), key=lambda r: r.k) for t in r.input_ids] for lane in total}
    for lane, n in total.items():
        own = sorted((r for r in rows if r.lane == lane), key=lambda r: r.chunk_id)
        assert [r.chunk_id for r in own] == list(range((n - 1) // size))
        for r in own:
            at = r.chunk_id * size
            assert r.input_ids == tokens[lane][at: at + size] and r.labels == tokens[lane][at + size]
            assert r.source[0].start == 0 and r.source[-1].end == size and all(a.end == b.start for a, b in zip(r.source, r.source[1:]))


def test_the_rest_of_a_batch_is_cut_before_it_meets_one_task(spark, docs_mid, monkeypatch):
    """The carried tokens are few; no task reads all runs to find them."""
    from pyspark.sql import DataFrame
    asked = []
    whole = DataFrame.coalesce
    monkeypatch.setattr(type(docs_mid), "coalesce", lambda self, n: asked.append(n) or whole(self, n))
    seg = J.write_segments(docs_mid.withColumn("k", order_key(F.col("doc_id"))), spark, "t_rest", 2)
    out = J.stream_pack(spark, J.document_stream(spark, seg), 128)
    assert not asked and spark.read.parquet(out).count() > 0


def test_a_lane_holds_places_not_tokens():
    """A micro-batch far above what a lane may hold, cut into chunks by small frames."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    class State:
        exists, kept = False, None

        def update(self, x):
            self.kept = x
    docs, size = 4000, 2000
    order = np.random.default_rng(5).permutation(docs)

    def frames():
        for i in range(0, docs, 100):
            ks = order[i: i + 100]
            yield pd.DataFrame({"k": [f"{k:08d}" for k in ks], "source": "a", "input_ids": [np.full(size, k, np.int32) for k in ks]})
    state, at = State(), 0
    tracemalloc.start()
    for f in J._pack_lane(500)((1,), frames(), state):
        for cid, ids, lab in zip(f["chunk_id"], f["input_ids"], f["labels"]):
            assert cid == at and set(ids) == {at * 500 // size} and lab == (at + 1) * 500 // size
            at += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == (docs * size - 1) // 500 and state.kept[0] == at
    assert peak < docs * size * 4 / 2          # half of the batch's ids


def test_segments_are_written_without_a_range_sample_of_the_texts(spark, monkeypatch):
    """Sampling a key for repartitionByRange reads whole rows, once more for every segment."""
    from longloom.session import scratch_path
    docs = spark.range(400).select(F.when(F.col("id") < 390, F.col("id")).alias("doc_id"), F.lit("a b").alias("text"))
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda *a: pytest.fail("the texts are sampled"))
    for i in range(4):
        path = J.write_segments(docs.withColumn("k", order_key(F.col("doc_id"))), spark, "x", 4, only=[i], path=scratch_path(spark, "t_seg"))
        rows = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
        assert len(rows) == 4 and min(r.n for r in rows) > 10
        assert all(a.hi < b.lo for a, b in zip(rows, rows[1:])) and all(int(r.lo[0], 16) // 4 == int(r.hi[0], 16) // 4 == i for r in rows)


def test_range_bounds_leave_no_range_out():
    assert J.range_bounds([], 4) == [] and J.range_bounds([5] * 100, 4) == [5]
    assert J.range_bounds([1] * 25 + [2] * 25 + [3] * 25 + [4] * 25, 4) == [1, 2, 3]
    assert J.range_bounds([1] * 97 + [2, 3, 4], 4) == [1, 2, 3]


def test_one_lane_is_packed_in_one_partition_and_written_by_many_tasks(spark, docs_mid):
    import os

    from longloom.session import scratch_path
    base = scratch_path(spark, "t_lane_tasks")
    seg = J.write_segments(docs_mid.withColumn("k", order_key(F.col("doc_id"))), spark, "t_lane_one", 1)
    before = spark.conf.get(J.SHUFFLE), spark.conf.get(J.CLEANUP)
    out = J.stream_pack_lanes(spark, J.document_stream(spark, seg), 128, 1, base=base)
    assert (spark.conf.get(J.SHUFFLE), spark.conf.get(J.CLEANUP)) == before
    rows = [r.n for r in spark.read.parquet(out).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(rows) == 4 and max(rows) - min(rows) <= 1          # local[4]
    stores = f"{base.removeprefix('file:')}/checkpoint/state/0"
    assert [x for x in os.listdir(stores) if x.isdigit()] == ["0"]
