"""Result sink by cell, incremental scan with quarantine, mergeable length sketches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from longloom.operators import length_sketch as LS
from longloom.operators import report
from longloom.sources import results as RS
from longloom.sources.io import NEEDLE_RESULT


def _result(model, length, depth, response="x", version=1):
    return {"model": model, "context_length": length, "depth_percent": depth, "version": version, "needle": "n",
            "model_response": response, "score": 1.0, "test_duration_seconds": 0.5, "test_timestamp_utc": "t", "file_name": "f"}


def _frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], NEEDLE_RESULT)


def test_two_runs_over_halves_equal_one_run(spark, tmp_path):
    rows = [_result("org/m-1", length, float(d), f"{length}:{d}") for length in (100, 200, 300) for d in (0, 11, 50)]
    key = lambda df: sorted((r.model, r.context_length, r.depth_percent, r.model_response) for r in df.collect())
    halves, once = str(tmp_path / "halves"), str(tmp_path / "once")
    assert RS.read_cells(spark, halves).count() == 0
    RS.upsert_cells(_frame(spark, rows[:5]), halves)
    RS.upsert_cells(_frame(spark, rows[4:]), halves)                # cell 4 is replayed
    RS.upsert_cells(_frame(spark, rows), once)
    assert key(RS.read_cells(spark, halves)) == key(RS.read_cells(spark, once)) == key(_frame(spark, rows))
    RS.upsert_cells(_frame(spark, [_result("org/m-1", 100, 0.0, "new")]), halves)
    assert len(key(RS.read_cells(spark, halves))) == 9 and ("org/m-1", 100, 0.0, "new") in key(RS.read_cells(spark, halves))
    # resume reads what is there
    todo = _frame(spark, rows + [_result("org/m-1", 400, 11.0)]).select("model", "context_length", "depth_percent")
    left = report.resume(todo, RS.read_cells(spark, halves)).collect()
    assert [(r.context_length, r.depth_percent) for r in left] == [(400, 11.0)]


@pytest.mark.parametrize("whole", [True, False])
def test_each_file_is_read_once_and_broken_ones_are_reported(spark, tmp_path, whole):
    folder, ledger = tmp_path / "results", str(tmp_path / "ledger")
    (folder / "sub").mkdir(parents=True)
    text = (lambda *r: json.dumps(list(r), indent=2)) if whole else (lambda *r: "\n".join(map(json.dumps, r)))
    (folder / "a.json").write_text(text(_result("m", 1, 0.0), _result("m", 2, 0.0)))
    (folder / "sub" / "b.json").write_text(text(_result("m", 3, 0.0)))
    (folder / "broken.json").write_text('{"model": "m", "context')
    (folder / "poor.json").write_text(json.dumps({"model": "m"}))
    now = lambda: sorted((r.context_length, r.model_response) for r in RS.current_results(spark, ledger).collect())
    assert RS.scan_results(spark, str(folder), ledger, whole_files=whole) == 0
    assert now() == [(1, "x"), (2, "x"), (3, "x")]
    bad = {r.path.rsplit("/", 1)[1]: r.reason for r in RS.quarantine(spark, ledger).collect()}
    assert bad == {"broken.json": "no JSON document", "poor.json": "a required field is missing"}
    # nothing new
    RS.scan_results(spark, str(folder), ledger, whole_files=whole)
    assert now() == [(1, "x"), (2, "x"), (3, "x")] and spark.read.parquet(f"{ledger}/files").count() == 4
    # one new file, one changed, one mended
    (folder / "c.json").write_text(text(_result("m", 9, 0.0, "late")))
    for name, content in (("a.json", text(_result("m", 2, 0.0, "again"))), ("broken.json", text(_result("m", 5, 0.0, "mended")))):
        (folder / name).write_text(content)
        os.utime(folder / name, (2e9, 2e9))
    RS.scan_results(spark, str(folder), ledger, whole_files=whole)
    assert now() == [(2, "again"), (3, "x"), (5, "mended"), (9, "late")]
    assert [r.path.rsplit("/", 1)[1] for r in RS.quarantine(spark, ledger).collect()] == ["poor.json"]
    assert spark.read.parquet(f"{ledger}/files").count() == 7


def test_sketch_bound_and_merge(spark, docs_mid, tmp_path):
    d = docs_mid.select("source", F.col("n_chars").alias("v"))
    odd = spark.createDataFrame([(None, 0), (None, 1), (None, 2 ** 62), (None, -5), ("src0", None)], "source string, v long")
    d = d.unionByName(odd)
    whole = LS.sketch(d, "v")
    parts = [LS.sketch(d.filter(F.pmod(F.hash("v"), F.lit(4)) == i), "v") for i in range(4)] + [LS.sketch(d.filter("v is null"), "v")]
    for i, p in enumerate(parts):
        LS.store(p, str(tmp_path / "s"), str(i))
    LS.store(parts[0], str(tmp_path / "s"), "0")                    # the same run again
    merged = LS.load(spark, str(tmp_path / "s"))
    key = lambda df: sorted(map(str, (r.asDict() for r in df.select("source", "low", "width", "n", "total", "vmin", "vmax").collect())))
    assert key(whole) == key(merged) == key(LS.merge(*parts))
    ps = [0, 1, 25, 50, 90, 99, 100]
    values = {}
    for r in d.filter("v is not null").collect():
        values.setdefault(r.source, []).append(max(r.v, 0))
    for r in LS.quantiles(merged, percentiles=ps).collect():
        v = sorted(values[r.source])
        assert r.n == len(v) and r.total == sum(v)
        for p in ps:
            exact = v[max(0, -(-p * len(v) // 100) - 1)]
            assert abs(r[f"p{p}"] - exact) <= exact * 2 ** -LS.BITS, (r.source, p)
    assert merged.groupBy("source").count().agg(F.max("count")).first()[0] <= 64 * 2 ** LS.BITS


def test_long_values_fill_few_buckets(spark):
    df = spark.range(200_000).select(F.lit("s").alias("source"), (F.col("id") * 7919).alias("v"))
    assert LS.sketch(df, "v").count() < 3000
