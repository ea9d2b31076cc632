import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lorespark.session import local_session

    return local_session(cpus=int(os.environ.get("TEST_CPUS", "4")), shuffle_partitions=4, app="tests")


@pytest.fixture(scope="session")
def sf():
    return SF
