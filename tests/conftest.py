import pytest

from waymark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(cpus=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
