import json
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
CHEAP = ["corpus_scan", "length_profile", "sample_per_source", "sample_global", "budget_prefix", "tokenize",
         "pack_chunks", "segment_length_profile", "qa_f1", "normalize_en", "render_prompts", "needle_recall",
         "needle_heatmap", "stream_sampling_report"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {"source", "n", "total", "portion"} <= set(df.columns)
    assert rows and abs(sum(r.portion for r in rows) - 1) < 1e-4


def test_every_oracle_has_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("gone", [["longloom/llm", "tests/llm"], ["longloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_library_without_the_optional_subpackage(tmp_path, gone):
    """The other queries stay when the subpackage, with or without the pipeline, is not there."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    skip = {os.path.join(root, g) for g in gone}
    copy = shutil.copytree(root, tmp_path / "copy", ignore=lambda d, names: [
        n for n in names if n in (".git", "__pycache__") or os.path.join(d, n) in skip])
    code = ("import __spark_entry__ as E, json; q, o = E.queries(), E.oracle_sql(); "
            "print(json.dumps([sorted(q), sorted(o)]))")
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": str(copy)}).stdout
    q, o = json.loads(out.strip().splitlines()[-1])
    own = sorted(n for n in E.queries() if n != "pipeline" and not re.match(r"op\d+_", n))
    assert q == own and set(o) <= set(q) and len(q) >= 70


def _norm(v):
    if type(v).__name__ == "NAType":
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.mark.parametrize("name", CHEAP)
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in ["documents", "benchmark", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    s = E.queries()[name](spark, SF).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    cols = sorted(s.columns)
    assert cols == sorted(d.columns)
    key = lambda r: repr(r)
    rs = sorted((tuple(_norm(x) for x in r) for r in s[cols].itertuples(index=False)), key=key)
    rd = sorted((tuple(_norm(x) for x in r) for r in d[cols].itertuples(index=False)), key=key)
    assert rs == rd
