import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bazaarlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", shuffle_partitions=4,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "6g",
               "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    def collect(df, *columns):
        return sorted(
            (tuple(r[c] for c in (columns or df.columns)) for r in df.collect()),
            key=lambda t: tuple((v is None, str(type(v)), v) for v in t),
        )

    return collect
