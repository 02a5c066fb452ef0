import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from repolith.session import local_session

    session = local_session(8, 8, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
