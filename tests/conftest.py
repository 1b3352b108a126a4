import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from slate import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session.build("tests", master="local[4]", cores=4)
    built.sparkContext.setLogLevel("ERROR")
    session.ship(built)
    yield built
    built.stop()
