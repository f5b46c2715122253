import os

import pytest

from sieveline.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", os.environ.get("TEST_CPUS", "4"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """The rows of a DataFrame as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
