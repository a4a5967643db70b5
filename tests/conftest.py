import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import session


@pytest.fixture(scope="session")
def spark():
    return session("tests")


@pytest.fixture
def sources(spark):
    """Build a sources table from (path, code) pairs."""

    def make(*pairs, program="p"):
        rows = [(seq, program, path, code) for seq, (path, code) in enumerate(pairs)]
        return spark.createDataFrame(rows, "source_seq long, program string, path string, code string")

    return make
