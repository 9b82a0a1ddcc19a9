import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from toolwarden.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def tools_df(spark):
    """Tools table from (scan_id, pos, name, description, input_schema) tuples."""
    def make(rows):
        return spark.createDataFrame(
            rows, "scan_id bigint, pos int, name string, description string, input_schema string")
    return make
