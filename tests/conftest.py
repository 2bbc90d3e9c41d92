import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sessionlake.session import build_session  # noqa: E402
from tests import sessions  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("spark")
    out = build_session(
        "tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="3g",
        spark_checkpoint_dir=f"file://{where}/checkpoints", spark_sql_warehouse_dir=f"{where}/warehouse",
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def two(tmp_path_factory):
    """Paths of two sessions."""
    where = tmp_path_factory.mktemp("sessions")
    return [sessions.write(str(where / f"s{i}.zarr"), i) for i in range(2)]
