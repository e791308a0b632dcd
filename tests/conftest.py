"""One local session for all tests."""

import pytest

from scriptorium.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()
