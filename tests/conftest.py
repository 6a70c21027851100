import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagefold.session import build_session

    s = build_session(master="local[4]", app="pagefold-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string")
    return make
