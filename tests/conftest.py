import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    # Inputs are tiny: compiling and re-planning each of many small jobs would take most of the time. TEST_PLANS=adaptive does both all the same.
    conf = {"spark__sql__shuffle__partitions": "2", "spark__sql__codegen__wholeStage": "false", "spark__sql__adaptive__enabled": "false"}
    if os.environ.get("TEST_PLANS") == "adaptive":
        conf = {"spark__sql__shuffle__partitions": "8"}
    session = build_session("tests", "local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
