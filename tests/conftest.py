import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hemline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Values of a column function over a list of inputs."""

    def run(function, inputs, dtype="string"):
        rows = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {dtype}")
        return [row["y"] for row in rows.select("i", function("x").alias("y")).orderBy("i").collect()]

    return run
