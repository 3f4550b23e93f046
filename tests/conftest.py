import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__  # noqa: E402,F401  (lets workers unpickle the package)
from quillmark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plan_of():
    return plan


@pytest.fixture
def rows():
    """Rows of a table as a sorted list of tuples."""

    def read(df, *names):
        return sorted((tuple(r) for r in df.select(*(names or df.columns)).collect()), key=repr)

    return read
