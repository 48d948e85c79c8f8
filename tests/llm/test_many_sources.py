"""Mixing more sources than are weighed in one row, and sources of a tiny share."""

import pytest

from longloom.llm import mixing

COLUMNS = "doc_id long, source string, text string"


def test_no_number_of_sources_is_refused(spark):
    n = 2_100
    docs = spark.createDataFrame([(i, f"s{i % n}", "w " * (1 + i % n % 7)) for i in range(n + 50)], COLUMNS)
    copies = {}
    for r in mixing.mix(docs, max_repetition=2.0).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert len(copies) == n + 50 and set(copies.values()) <= {1, 2} and max(copies.values()) == 2


@pytest.mark.parametrize("limits", [{"max_repetition": 2.0}, {"max_repetition": 1.0}, {"max_repetition": 1e9},
                                    {"max_repetition": None, "target_entropy": 1.3}, {"max_repetition": 3.0, "budget": 30_000}])
def test_many_sources_as_few(spark, monkeypatch, limits):
    docs = spark.createDataFrame([(i, f"s{(i * i) % 11 % 5}", "w " * (i % 30)) for i in range(600)], COLUMNS)

    def rows():
        out = mixing.mix(docs, **limits).select("doc_id", "_epoch", "_block", "_n_tokens", "_weight").collect()
        return sorted((r.doc_id, r._epoch, r._block, r._n_tokens, round(r._weight, 8)) for r in out)
    few = rows()
    monkeypatch.setattr(mixing, "ROW_SOURCES", 2)
    assert rows() == few


@pytest.mark.parametrize("weigh", ["source_weights", "_many_weights"])
def test_tiny_sources_keep_their_weight(spark, weigh):
    totals = spark.createDataFrame([("big", 10**13), ("small", 3), ("word", 1)], "s string, t long")
    got = {r.s: r for r in getattr(mixing, weigh)(totals, 2.0, None, None).collect()}
    passes = {s: r.weight * r.total_budget / r.t for s, r in got.items()}
    assert passes["big"] == pytest.approx(1, rel=1e-6) and passes["word"] == pytest.approx(2, rel=1e-6)
    assert 1 < passes["small"] < 2
