import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid.session import HOT_GROUP_ROWS, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def hot(spark):
    """Force the range-bucketed path for groups above 20 rows."""
    spark.conf.set(HOT_GROUP_ROWS, "20")
    yield
    spark.conf.unset(HOT_GROUP_ROWS)
