import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from longloom.session import build_session
    s = build_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def docs_small(spark):
    from longloom.sources.tables import read_table
    return read_table(spark, SF001, "documents")


@pytest.fixture(scope="session")
def docs_mid(spark):
    from longloom.sources.tables import read_table
    return read_table(spark, SF01, "documents")
