import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siteframe.core import build_session  # noqa: E402
from siteframe.domain import Domain  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(os.environ.get("TEST_MASTER", "local[8]"), 4, "6g", **{"spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def domain(spark):
    return Domain(spark, "/root/testdata/sf0.001")
