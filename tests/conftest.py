import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from sensorloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", memory="4g")
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def fixtures(spark):
    from sensorloom.plans.fixtures import Fixtures
    return Fixtures(spark, DATA)
