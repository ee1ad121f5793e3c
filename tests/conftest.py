from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tipoff.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data(spark):
    from tipoff.queries.views import Data

    return Data(spark, SF)


@pytest.fixture(scope="session")
def rows():
    """Collect as sorted tuples, doubles rounded, so that frames can be compared."""

    def collect(df, *columns, digits=9):
        def clean(v):
            return round(v, digits) if isinstance(v, float) else v

        picked = df.select(*columns) if columns else df.select(*sorted(df.columns))
        out = [tuple(clean(v) for v in r) for r in picked.collect()]
        return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))

    return collect
