import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks import verify  # noqa: E402
from sward.session import tune  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = tune(verify.session(cores=8, memory="8g"))
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def database():
    return verify.database(SMALL)


@pytest.fixture
def rows():
    def collect(df, *cols):
        cols = cols or df.columns
        found = [tuple(r[c] for c in cols) for r in df.collect()]
        return sorted(found, key=lambda r: [(v is None, v if v is not None else 0) for v in r])

    return collect
