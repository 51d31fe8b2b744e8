import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidings.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session(
        "tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={"spark.sql.warehouse.dir": str(warehouse)},
    )
    yield session
    session.stop()
