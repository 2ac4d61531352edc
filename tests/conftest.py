import os
import sys

import pandas as pd
import pytest
from pyspark.sql.types import StructType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from irquarry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[*]", 8, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """A small table from rows and a schema."""

    def make(rows, schema):
        names = StructType.fromDDL(schema).fieldNames()
        columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
        frame = pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in columns.items()})
        return spark.createDataFrame(frame, schema)

    return make


@pytest.fixture
def evaluate(table):
    """Value of a column expression over one row of strings."""

    def run(expression, **values):
        schema = ", ".join(f"{n} string" for n in values)
        return table([tuple(values.values())], schema).select(expression.alias("out")).head()[0]

    return run
