"""Ranked lexical search: blocks of items, small tries, bounds, ties, high counts."""

import numpy as np
import pytest

from longloom.llm import catalog, lexical_search
from longloom.llm.common import read
from llm_helpers import oracle_rows, spark_rows, write, odd_tables

NAME = "op13_lexical_search"


def test_small_tries_and_item_blocks(spark, odd_dir, monkeypatch):
    want = oracle_rows(catalog.ORACLE[NAME], odd_dir)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 12)
    monkeypatch.setattr(lexical_search, "MATRIX_BYTES", 1)
    monkeypatch.setattr(lexical_search, "SMALL", 1)
    assert spark_rows(catalog.QUERIES[NAME](spark, odd_dir)) == want and len(want[1]) > 20


def test_repeated_rows_items_and_null_ids(spark, repeated_dir):
    assert spark_rows(catalog.QUERIES[NAME](spark, repeated_dir)) == oracle_rows(catalog.ORACLE[NAME], repeated_dir)


def test_small_scale(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(catalog.QUERIES[NAME](spark, sf)) == oracle_rows(catalog.ORACLE[NAME], sf)


def test_ties_hot_copies_and_high_counts(spark, tmp_path):
    """A third of the documents are equal; one document repeats a term more often than 16 bits count."""
    t = odd_tables()
    texts = ["same words in many copies"] * 40 + [f"word{i % 7} and other text {i}" for i in range(80)] + ["often " * 70_000 + "copies", "often", None, "?!"]
    t["documents"] = {"doc_id": [i // 2 if i % 5 else None for i in range(len(texts))], "text": texts}
    t["benchmark"] = {"item_id": [1, 1, None, 4], "text": ["many copies of other words", "many copies of other words", "OFTEN word3", "nothing?"]}
    folder = write(tmp_path, t)
    assert spark_rows(catalog.QUERIES[NAME](spark, folder)) == oracle_rows(catalog.ORACLE[NAME], folder)


@pytest.mark.parametrize("small", [1, 4, 64])
def test_bounds_hold_and_branches_are_left_out(monkeypatch, small):
    monkeypatch.setattr(lexical_search, "SMALL", small)
    rng = np.random.default_rng(5)
    n, width, k = 400, 60, 3
    vectors = [np.unique(rng.geometric(0.08, rng.integers(1, 12)) % width) for _ in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    ranks, tfs = np.concatenate(vectors), rng.integers(1, 9, ends[-1])
    m, ids = rng.integers(10, 400, n), rng.permutation(n)
    trie = lexical_search.Trie(ids, m, ends, ranks, tfs, width)
    terms = np.array([3, 20, 35, 50])
    weights = np.array([500, 2500, 4000, 6000])
    score = trie.bound(np.arange(n), terms, weights)
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), np.diff(ends)), ranks] = tfs
    for leaf, doc in enumerate(trie.order.tolist()):
        want = sum(w * (1_000_000_000 * int(dense[doc, t]) // (1000 * int(dense[doc, t]) + 8 * int(m[doc]))) for t, w in zip(terms, weights))
        assert score[leaf] == want and trie.least[leaf] == ids[doc]

    def below(node):
        return [node] if node < n else [x for c in trie.children[node - n] for x in below(c)]
    assert sorted(below(trie.root)) == list(range(n))
    for node in range(n, trie.inner):
        assert trie.bound(np.array([node]), terms, weights)[0] >= score[below(node)].max()
    seen, bound = [], trie.bound
    trie.bound = lambda nodes, t, w: seen.extend(nodes) or bound(nodes, t, w)
    best = trie.search(terms, weights, [], k)
    assert best == sorted((-int(s), int(i)) for s, i in zip(score, trie.least[:n]) if s > 0)[:k]
    assert len([x for x in seen if x < n]) < n


def test_all_documents_are_ranked(spark):
    got = catalog.QUERIES[NAME](spark, "/root/testdata/sf0.01")
    items = read(spark, "/root/testdata/sf0.01", "benchmark").count()
    assert got.count() == 10 * items
