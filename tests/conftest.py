import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from workload.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """DataFrame -> sorted list of tuples."""

    def take(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    return take
