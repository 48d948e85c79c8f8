"""The corpus in stream order and the scan that stops when the budgets are full."""

import pytest
from models import sample_model
from pyspark.sql import functions as F

from longloom.operators import sampling, stream_order
from longloom.plans import fixtures as FX


@pytest.fixture(scope="module")
def table(spark, docs_mid):
    return stream_order.write_stream_order(docs_mid.select("doc_id", "source", "n_chars", "text"), n_parts=16)


def test_manifest_gives_the_stream_order(spark, docs_mid, table):
    want = {r.doc_id: r.pos for r in sampling.stream_position(docs_mid, FX.SPEC_PER_SOURCE).collect()}
    assert {r.doc_id: r.pos for r in table.positions(spark).collect()} == want
    m = table.manifest(spark).orderBy("part").collect()
    assert sum(r.rows for r in m) == len(want) and all(a.last_k < b.first_k for a, b in zip(m, m[1:]))
    assert [r.rows_before for r in m] == [sum(x.rows for x in m[:i]) for i in range(len(m))]
    files = spark.read.parquet(f"{table.path}/data").groupBy("part").agg(F.countDistinct("_metadata.file_name").alias("n"))
    assert files.filter("n > 1").count() == 0
    # the text is that of the corpus
    assert table.documents(spark).select("doc_id", "text").exceptAll(docs_mid.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("spec,mix", [(FX.SPEC_PER_SOURCE, FX.MIX_TEST), (FX.SPEC_PER_SOURCE_LARGE, FX.MIX_TEST), (FX.SPEC_GLOBAL, None),
                                      (FX.SPEC_NONE, None), (FX.SPEC_STARVED, FX.MIX_STARVED)])
def test_same_rows_as_the_whole_scan(spark, docs_mid, table, spec, mix):
    m = sampling.mix_frame(spark, mix) if mix else None
    scan = stream_order.sample_until_full(spark, table, spec, m)
    whole = sampling.sample(docs_mid, spec, m)
    assert sorted(map(tuple, scan.result.admitted.collect())) == sorted(map(tuple, whole.admitted.collect()))
    assert scan.result.stop_key == whole.stop_key and scan.rows_total == 1000
    if whole.stop_key is None:
        assert scan.rows_read == 1000                     # a source that never fills keeps the scan going
    else:
        assert scan.rows_read < 1000 and scan.rows_read >= whole.scanned().count()
    if spec is FX.SPEC_GLOBAL:
        rows = [tuple(r) for r in docs_mid.select("doc_id", "source", "n_chars").collect()]
        admitted, end, _ = sample_model(rows, spec.total_tokens, "global", ratio=spec.ratio, threshold=spec.threshold_tokens)
        assert {r.doc_id for r in scan.result.admitted.collect()} == set(admitted) and scan.rows_read < 2 * end + 130


def test_other_parts_are_not_opened(spark, table):
    files = table.documents(spark, 2).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert len(files) == 3 and all("/part=" in r.f for r in files)
    plan = table.documents(spark, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(part" in plan.split("PartitionFilters")[1][:80]


def test_null_and_repeated_ids_and_an_empty_corpus(spark):
    rows = [(None, "a", i) for i in range(40)] + [(5, "a", i) for i in range(10)] + [(i, "a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    t = stream_order.write_stream_order(df, n_parts=7)
    assert sorted(r.pos for r in t.positions(spark).collect()) == list(range(70))
    spec = sampling.SampleSpec(total_tokens=100, mode="none")
    scan = stream_order.sample_until_full(spark, t, spec)
    assert sorted(map(tuple, scan.result.admitted.collect()), key=str) == sorted(map(tuple, sampling.sample(df, spec).admitted.collect()), key=str)
    empty = stream_order.write_stream_order(df.limit(0), n_parts=3)
    assert stream_order.sample_until_full(spark, empty, spec).result.admitted.count() == 0 and empty.positions(spark).count() == 0
