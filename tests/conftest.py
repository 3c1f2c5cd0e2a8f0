import pytest

from spanwell.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", app="spanwell-tests", partitions=4)
    yield session
    session.stop()
