"""One session for all tests."""

import pytest

from siftwright.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
