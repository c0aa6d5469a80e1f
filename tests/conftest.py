import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


def _session():
    from redactum.session import get_spark

    return get_spark("local[4]", 4, app_name="redactum-tests")


def pytest_configure(config):
    _session()  # some test modules make columns when they are read


@pytest.fixture(scope="session")
def spark():
    yield _session()


def docs_df(spark, rows, fmt="txt"):
    """rows: list of (doc_id, text)."""
    return spark.createDataFrame([(d, t, fmt) for d, t in rows], "doc_id long, text string, fmt string")
