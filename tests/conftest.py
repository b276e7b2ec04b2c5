import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import local_session

    s = local_session("8", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def events(spark, tiny):
    from tidewatch.session import settle
    from tidewatch.sources.telemetry import access_events

    return settle(access_events(spark, tiny))
