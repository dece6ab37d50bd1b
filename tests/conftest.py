"""One small session for all tests."""

import os
import sys

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from folioforge.session import local_session

    session = local_session(cpus=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
