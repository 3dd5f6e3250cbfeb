import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import session, ship

    s = session(
        "local[4]", 4, spark__driver__memory="3g", spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="tidewater-test-"),
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
