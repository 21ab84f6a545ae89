import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from workweave.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
