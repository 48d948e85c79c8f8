import pytest
from models import sample_model

from longloom.operators import sampling
from longloom.operators.sampling import SampleSpec, parse_dataset_size
from longloom.plans import fixtures as FX


def _rows(df):
    return [(r.doc_id, r.source, r.n_chars) for r in df.select("doc_id", "source", "n_chars").collect()]


@pytest.mark.parametrize("budget", [3_000, 20_000, 50_000, 300_000, 10 ** 9])
@pytest.mark.parametrize("mix_name", ["plain", "up"])
def test_per_source_matches_loop(spark, docs_mid, budget, mix_name):
    mix = FX.MIX_TEST if mix_name == "plain" else FX.MIX_TEST_UPSAMPLED
    mode = "per_source" if mix_name == "plain" else "upsample_code_arxiv_book"
    spec = SampleSpec(total_tokens=budget, mode=mode, ratio=0.1, threshold_tokens=512)
    r = sampling.sample(docs_mid, spec, sampling.mix_frame(spark, mix))
    got = sorted(r.admitted.select("doc_id").toPandas().doc_id.tolist())
    want, scanned, counters = sample_model(_rows(docs_mid), budget, mode, mix)
    assert got == sorted(want)
    assert r.scanned().count() == scanned
    rep = {x.source: x for x in r.report().collect()}
    for s, c in counters.items():
        if s in rep:
            assert rep[s].passed == c["passed"] and rep[s].filtered == c["filtered"]


def test_fixture_counts(spark, docs_mid):
    spec = FX.SPEC_PER_SOURCE
    r = sampling.sample(docs_mid, spec, sampling.mix_frame(spark, FX.MIX_TEST))
    assert r.admitted.count() == 57
    assert r.scanned().count() == 492


@pytest.mark.parametrize("mode", ["global", "none"])
@pytest.mark.parametrize("budget", [5_000, 50_000, 10 ** 9])
def test_global_modes_match_loop(spark, docs_mid, mode, budget):
    spec = SampleSpec(total_tokens=budget, mode=mode, ratio=0.1, threshold_tokens=512)
    r = sampling.sample(docs_mid, spec)
    got = sorted(r.admitted.select("doc_id").toPandas().doc_id.tolist())
    want, scanned, _ = sample_model(_rows(docs_mid), budget, mode)
    assert got == sorted(want)
    assert r.scanned().count() == scanned


def test_starved_mix_scans_everything(spark, docs_small):
    spec = SampleSpec(total_tokens=50_000, mode="per_source", ratio=0.1, threshold_tokens=512)
    r = sampling.sample(docs_small, spec, sampling.mix_frame(spark, FX.MIX_STARVED))
    assert r.stop_key is None
    assert r.scanned().count() == docs_small.count()


def test_unknown_source_raises(spark, docs_small):
    spec = SampleSpec(total_tokens=50_000, mode="per_source", ratio=0.1, threshold_tokens=512)
    with pytest.raises(Exception, match="source not in mix"):
        sampling.sample(docs_small, spec, sampling.mix_frame(spark, FX.MIX_MISSING))
    lenient = SampleSpec(total_tokens=50_000, mode="per_source", ratio=0.1, threshold_tokens=512, strict_sources=False)
    r = sampling.sample(docs_small, lenient, sampling.mix_frame(spark, FX.MIX_MISSING))
    assert r.admitted.filter("source = 'src19'").count() == 0
    u = sampling.unknown_sources(docs_small, sampling.mix_frame(spark, FX.MIX_MISSING)).collect()
    assert [(x.source, x.n_docs) for x in u] == [("src19", 10)]


def test_partition_count_invariance(spark, docs_mid):
    spec = FX.SPEC_PER_SOURCE_LARGE
    mix = sampling.mix_frame(spark, FX.MIX_TEST)
    a = sorted(sampling.sample(docs_mid, spec, mix).admitted.toPandas().doc_id)
    b = sorted(sampling.sample(docs_mid.repartition(13), spec, mix).admitted.toPandas().doc_id)
    spec2 = SampleSpec(total_tokens=spec.total_tokens, mode=spec.mode, ratio=spec.ratio,
                       threshold_tokens=spec.threshold_tokens, bucket_digits=1)
    c = sorted(sampling.sample(docs_mid, spec2, mix).admitted.toPandas().doc_id)
    assert a == b == c


def test_dataset_size_literal():
    assert parse_dataset_size("test") == 2_000_000
    assert parse_dataset_size("100m") == 100_000_000
    assert parse_dataset_size("5b") == 5_000_000_000
    assert parse_dataset_size("5B") == 5_000_000_000
    assert parse_dataset_size("1.5b") == 1_500_000_000
    with pytest.raises(ValueError):
        parse_dataset_size("12x")


def test_planned_chunks():
    assert sampling.planned_chunks(parse_dataset_size("5b"), 131072) == 38146
    assert sampling.planned_chunks(100, 512) == 0


def test_threshold_chars():
    spec = SampleSpec(total_tokens=1, threshold_tokens=4096)
    n = spec.threshold_chars
    assert n / 3.68 >= 4096 and (n - 1) / 3.68 < 4096


def test_attach_text_candidates(spark, docs_mid):
    from longloom.operators import packing
    r = sampling.sample(docs_mid, FX.SPEC_PER_SOURCE_LARGE, sampling.mix_frame(spark, FX.MIX_TEST))
    adm = r.admitted.select("doc_id", "source", "k")
    a = packing.attach_text(adm, docs_mid)
    b = packing.attach_text(adm, docs_mid, candidates=r.candidates)
    key = lambda df: sorted((x.doc_id, x.text) for x in df.select("doc_id", "text").collect())
    assert key(a) == key(b)
    # candidates are a small superset of the admitted rows
    assert r.candidates(docs_mid).count() < 2 * adm.count()


def test_profile_percentiles_are_exact(spark, docs_mid):
    import numpy as np
    from pyspark.sql import functions as F
    from longloom.operators import profile
    d = docs_mid.select("source", F.col("n_chars").alias("x"))
    values = d.toPandas().groupby("source").x.apply(list).to_dict()
    for r in profile.length_profile(d, "x").collect():
        assert r.n == len(values[r.source]) and r.total == sum(values[r.source])
        assert [r.p25, r.p50, r.p95, r.p100] == pytest.approx(np.percentile(values[r.source], [25, 50, 95, 100]).tolist())


def test_json_ids_do_not_depend_on_splits(spark, docs_mid, tmp_path):
    from pyspark.sql import functions as F
    from longloom.sources.tables import corpus_scan
    raw = docs_mid.select("text", F.struct(F.col("source").alias("redpajama_set_name")).alias("meta"))
    raw.unionByName(raw.limit(20)).repartition(3).write.json(str(tmp_path / "raw"))
    seen = []
    for size in ("64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = corpus_scan(spark, str(tmp_path / "raw"), "json", with_text=True).collect()
        seen.append(sorted((r.doc_id, r.text) for r in rows))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len({i for i, _ in seen[0]}) == len(seen[0]) == 1020


def test_missing_length_column(spark, docs_mid, tmp_path):
    from longloom.sources.tables import corpus_scan
    docs_mid.drop("n_chars").write.parquet(str(tmp_path / "d"))
    assert all(r.n_chars == len(r.text) for r in corpus_scan(spark, str(tmp_path / "d"), with_text=True).collect())


def test_report_budget_and_fill(spark, docs_mid):
    r = sampling.sample(docs_mid, FX.SPEC_PER_SOURCE_LARGE, sampling.mix_frame(spark, FX.MIX_TEST))
    for row in r.report().collect():
        w = dict(FX.MIX_TEST)[row.source]
        assert row.budget_tokens == pytest.approx(FX.BUDGET_LARGE * w)
        assert row.fill == pytest.approx(row.used_chars / 3.68 / row.budget_tokens)
        # a source never goes over its budget by more than its last admitted document
        assert row.used_chars / 3.68 <= row.budget_tokens + 128_657 / 3.68


def test_null_and_repeated_ids_keep_every_row(spark):
    """Four rows in, four positions, four admitted rows and four texts out, each text once."""
    from longloom.operators import packing
    rows = [(None, "a", 9, "null id"), (7, "a", 4, "once"), (7, "a", 4, "again"), (7, "b", 4, "elsewhere"), (None, None, 5, "no source")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string")
    spec = SampleSpec(total_tokens=1000, mode="none")
    pos = sampling.stream_position(docs, spec).collect()
    assert sorted(r.pos for r in pos) == list(range(5))
    res = sampling.sample(docs, spec)
    assert sorted(r.offset for r in res.admitted.collect())[0] == 0 and res.admitted.count() == 5
    for candidates in (None, res.candidates):
        text = packing.attach_text(res.admitted, docs, candidates=candidates).collect()
        assert sorted(r.text for r in text) == sorted(r[3] for r in rows)
    mix = sampling.mix_frame(spark, [("a", 0.5), ("b", 0.5)])
    lenient = sampling.sample(docs, SampleSpec(total_tokens=1000, ratio=1.0, strict_sources=False), mix)
    assert sorted(r.source for r in lenient.admitted.collect()) == ["a", "a", "a", "b"]


def test_running_sum_of_null_groups_and_keys(spark):
    from longloom.operators.prefix import range_bucket, running_sum
    rows = [(None, 1, 5), (None, None, 2), ("g", 1, 7), ("g", 3, 1), ("g", None, 4), (None, 9, 1)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    got = sorted((r.g or "", r.o if r.o is not None else -1, r.s) for r in
                 running_sum(df, "v", ["o"], range_bucket(df, "o", 2), by=["g"], out="s").collect())
    assert got == [("", -1, 2), ("", 1, 7), ("", 9, 8), ("g", -1, 4), ("g", 1, 11), ("g", 3, 12)]
