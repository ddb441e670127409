import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tremorline.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def make_series(spark):
    """Sensor rows from arrays: {id: (x, y)} with one second between rows."""
    import datetime

    def build(data):
        start = datetime.datetime(2023, 1, 1)
        rows = [
            (key, start + datetime.timedelta(seconds=i), float(a), float(b))
            for key, (x, y) in data.items()
            for i, (a, b) in enumerate(zip(x, y))
        ]
        return spark.createDataFrame(rows, "id int, time timestamp_ntz, x double, y double").repartition(7)

    return build
