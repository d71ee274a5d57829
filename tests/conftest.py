import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from viewloom.session import build_session

    s = build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def same():
    """Rows of a DataFrame as a sorted list of tuples equal those expected."""

    def check(df, expected):
        got = sorted((tuple(r) for r in df.collect()), key=repr)
        assert got == sorted(map(tuple, expected), key=repr)

    return check
