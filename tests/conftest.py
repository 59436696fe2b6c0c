import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidepool.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", "tests")
    yield session
    session.stop()


@pytest.fixture
def skewed(spark):
    """Everything over 3 rows per key counts as hot and nothing is small enough to broadcast by itself."""
    spark.conf.set("spark.tidepool.hotRows", "3")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.tidepool.hotRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
