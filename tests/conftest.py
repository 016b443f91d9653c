import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from trackwright.session import drop_scratch, local_session

    session = local_session(4, 4)
    yield session
    drop_scratch(session)
    session.stop()
