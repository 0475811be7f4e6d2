import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples of the named columns."""
    def collect(df, *names):
        return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=str)
    return collect
