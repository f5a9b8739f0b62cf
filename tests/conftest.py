"""One local session for all tests, and the driver's tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from brightloom.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/brightloom-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def tiny() -> str:
    return str(TABLES / "sf0.001")
