import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("wardlight-tests", "local[8]", **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame('a INT, b STRING', rows) -> DataFrame; rows may hold ISO strings for times."""

    def make(schema, rows):
        loose = ", ".join(
            f"{c.split()[0]} STRING" if c.split()[1].upper() in ("TIMESTAMP_NTZ", "TIMESTAMP", "DATE") else c
            for c in (x.strip() for x in schema.split(","))
        )
        df = spark.createDataFrame(rows, loose)
        casts = [f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in (x.strip() for x in schema.split(","))]
        return df.selectExpr(*casts)

    return make
