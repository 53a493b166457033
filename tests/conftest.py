import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tilewright.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    out = session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    out.sparkContext.setLogLevel("ERROR")
    return out
