import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tools.local_session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from registered.inputs import Inputs

    return Inputs(spark, "/root/testdata/sf0.001")
