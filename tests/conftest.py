import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from sentrymill.session import local_session

    session = local_session("sentrymill-tests", cores=4, partitions=4)
    yield session
    session.stop()
