import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from chainsift.session import local_session

    s = local_session(4, shuffle_partitions=8, app="chainsift-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chainsift-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="chainsift-test-", dir="/tmp")
