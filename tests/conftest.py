import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TIDEWIRE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidewire.session import local_session

    os.environ.setdefault("TIDEWIRE_DRIVER_MEMORY", "4g")
    session = local_session(4, 4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
