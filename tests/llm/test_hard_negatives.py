"""Hard-negative mining: small shards and blocks, pruning, large components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longloom.llm import catalog, hard_negatives
from longloom.llm.common import read
from llm_helpers import oracle_rows, spark_rows

NAME = "op11_hard_negatives"


def test_small_shards_and_anchor_blocks(spark, odd_dir, monkeypatch):
    want = oracle_rows(catalog.ORACLE[NAME], odd_dir)
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 24 * 9)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "FIRST_VISIT", 2)
    assert spark_rows(catalog.QUERIES[NAME](spark, odd_dir)) == want and len(want[1]) > 20


def test_repeated_tables(spark, repeated_dir):
    assert spark_rows(catalog.QUERIES[NAME](spark, repeated_dir)) == oracle_rows(catalog.ORACLE[NAME], repeated_dir)


def _brute(rows, k=5):
    out = []
    for n, (i, lab, x) in enumerate(rows):
        if i % 10:
            continue
        s = sorted(((-sum(a * b for a, b in zip(x, y)), j, m, l2) for m, (j, l2, y) in enumerate(rows) if m != n))
        for sp, j, _, _ in [r for r in s if r[3] == lab][:k]:
            win = [r for r in s if r[3] != lab and 80 * -sp <= 100 * -r[0] <= 100 * -sp][:k]
            out += [(i, j, rank, r[1], -sp, -r[0]) for rank, r in enumerate(win, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [3, 1 << 26])
def test_brute_force_and_large_components(spark, size):
    """Scores beyond the exact range of doubles are integers too; other lengths take no part."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), [int(v) for v in rng.integers(-size, size + 1, 5)]) for i in range(160)]
    df = spark.createDataFrame([(i, l, [float(v) for v in x]) for i, l, x in rows] + [(161, 1, [1.0] * 4), (162, 1, []), (163, 1, [1e30] * 5)],
                               "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, scale=1, codewords=4).drop("label").collect()
    assert sorted(tuple(r) for r in got) == _brute(rows)


def test_far_cells_are_not_visited():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 8)) * 1000
    x = np.concatenate([np.rint(c + rng.normal(size=(500, 8))) for c in centres]).astype(np.int32)
    books = hard_negatives.codebook(x[:, :4].astype(float), 4), hard_negatives.codebook(x[:, 4:].astype(float), 4)
    cells = hard_negatives._assign(x[:, :4], books[0]) * len(books[1]) + hard_negatives._assign(x[:, 4:], books[1])
    x, cells = x[np.argsort(cells, kind="stable")], np.sort(cells)
    n = len(x)
    sh = hard_negatives._Shard(books, 0, np.arange(n), np.zeros(n, np.uint8), np.zeros(n, np.int64), cells, x)
    q = x[:1].astype(float)
    u, v, slack = sh.bounds(q)
    exact = x.astype(np.int64) @ x[0].astype(np.int64)
    h = sh.halves[0][0].shape[1]
    assert h == 4 and (u[0][sh.of[0]] + v[0][sh.of[1]] + slack[0] >= exact).all()
    seen, best = [], []

    def found(rows):
        seen.extend(rows)
        best[:] = sorted([*best, *exact[rows].tolist()], reverse=True)[:5]
    sh.visit(u[0], v[0], lambda: best[-1] if len(best) == 5 else -np.inf, found)
    assert len(seen) < n / 2 and best == sorted(exact.tolist(), reverse=True)[:5]


def test_hot_vector(spark):
    """A third of all rows are one vector: they are spread over the shards and ties go by id."""
    rows = [(i, i % 2, [1.0, 2.0] if i % 3 == 0 else [float(i % 7), 1.0]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(df, F.col("vec_id") == 0, scale=1).collect()
    want = [r for r in _brute([(i, l, [int(a) for a in x]) for i, l, x in rows]) if r[0] == 0]
    assert sorted(tuple(r)[:6] for r in got) == want


def test_whole_table_is_read(spark):
    df = read(spark, "/root/testdata/sf0.01", "embeddings")
    assert catalog.QUERIES[NAME](spark, "/root/testdata/sf0.01").select("anchor_id").distinct().count() <= df.filter("vec_id % 100 = 0").count()
