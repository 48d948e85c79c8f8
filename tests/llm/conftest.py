"""Small tables with the odd cases every operator must handle."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# in a run of the whole suite `conftest` is this module for the tests above too
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

from llm_helpers import KINDS, odd_documents, odd_tables, write  # noqa: E402


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory):
    return write(tmp_path_factory.mktemp("odd"), odd_tables())


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    tables = {t: {k: [] for k in cols if k in KINDS} for t, cols in odd_tables().items()}
    return write(tmp_path_factory.mktemp("empty"), tables)


@pytest.fixture(scope="session")
def repeated_dir(tmp_path_factory):
    """Every row of two documents twice, a doc_id with two texts, null ids, null keys elsewhere."""
    d = odd_documents()
    keep = [0, 6, 9, 10, 2, 1, 22]
    cols = {k: [d[k][i] for i in keep] for k in ("text", "lang", "source", "n_chars")}
    ids = [0, 18, 27, 30, 6, 3, 66]
    extra = [(0, d["text"][0]), (27, d["text"][9]), (30, d["text"][13][:900]), (None, d["text"][18]), (None, d["text"][18]), (None, None)]
    ids += [i for i, _ in extra]
    cols["text"] += [t for _, t in extra]
    for k, v in (("lang", "en"), ("source", "s0"), ("n_chars", 1)):
        cols[k] += [v] * len(extra)
    t = odd_tables()
    t["documents"] = {"doc_id": ids} | cols
    t["pages"]["page_id"][1] = None
    t["conversations"]["conv_id"][5] = None
    t["benchmark"]["item_id"][3] = None
    return write(tmp_path_factory.mktemp("repeated"), t)
