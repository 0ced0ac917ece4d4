import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from seqatlas.session import local_session

    session = local_session("tests", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    import __spark_entry__  # noqa: F401  registers the queries
    from catalog import Tables

    return Tables(spark, SF)
