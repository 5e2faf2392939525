import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quillon.session import reachable, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield reachable(s)
    s.stop()
