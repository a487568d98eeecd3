import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from confluo.session import local_session

    session = local_session(4, app="tests", **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoints"))})
    yield session
    session.stop()
