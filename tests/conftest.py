import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sqlcorpus.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    home = tempfile.mkdtemp(prefix="sqlcorpus-tests-")
    session = build_session(
        "tests", "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__sql__warehouse__dir=os.path.join(home, "warehouse"),
        spark__checkpoint__dir=os.path.join(home, "staging"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of tuples (nulls first)."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()),
                      key=lambda t: [(v is not None, str(v)) for v in t])
    return collect
