import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from studylake import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__sql__execution__arrow__maxRecordsPerBatch="1000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df):
    """Rows of a frame in a comparable order."""
    cols = sorted(df.columns)
    return sorted((tuple(str(v) for v in r) for r in df.select(*cols).collect()))
