from __future__ import annotations

import pytest

from ledgerloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
