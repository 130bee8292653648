import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("4", 4)
    yield s
    s.stop()


@pytest.fixture
def many_chunks(spark):
    """Keep small shuffles in several partitions, as large data would be."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
