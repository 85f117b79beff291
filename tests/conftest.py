import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from piisift.session import local_session, ship_package
    s = local_session(4, shuffle_partitions=4)
    ship_package(s)  # workers import piisift wherever the tests are started from
    yield s
    s.stop()
