import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from postsignal.session import local_session
    s = local_session("4", shuffle_partitions=8, memory="4g", app="postsignal-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL


@pytest.fixture(scope="module", autouse=True)
def own_caches():
    """Tables that a module's fixtures cache end with the module."""
    yield
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is not None:
        active.catalog.clearCache()
