import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from caudal.session import local_session

    return local_session(4, "tests", **{"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def rows(df):
    """The rows of a frame as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
