import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slotwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "slotwise-tests")


@pytest.fixture
def long_grid(spark):
    """Long grid out of {field: [values]}; slots start at ``first``."""

    def build(series, first=1000, name="plant"):
        rows = [
            (name, f, first + i, None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v))
            for f, values in series.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "series_id string, field string, pos long, value double")

    return build


def by_pos(df, column, **where):
    for k, v in where.items():
        df = df.where(f"{k} = '{v}'" if isinstance(v, str) else f"{k} = {v}")
    return {r["pos"]: r[column] for r in df.select("pos", column).collect()}


@pytest.fixture
def pick():
    return by_pos
