from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankweave.schemas import CASES  # noqa: E402
from rankweave.session import build_session  # noqa: E402

NOW = dt.datetime(2024, 5, 10, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


CASE_ROWS = [
    (12, 47, "M", "Dull chest pain", "chest ache, cough", None, "Muscle strain", "heat pack", None, "High"),
    (26, 36, "F", "Morning headache", "vomiting", "migraine", "Tension type",
     "sleep diary", "stable", "Critical"),
    (31, 40, "F", "Dyspnée at rest", "shortness of breath; chest pain", "", "Heart failure", "diuretics", "home", "High"),
    (32, 71, "M", 'Said "cannot breathe"', "short breath,\nwheezing", "asthma", "COPD", "x" * 1200 + " oxygen", "", "Low"),
    (45, 33, "F", "Pain in chest", "the pain of the chest", None, "Anxiety", "rest", None, "Low"),
]


@pytest.fixture(scope="session")
def cases(spark):
    stamp = dt.datetime(2024, 1, 1)
    rows = [(*r, 3, None, stamp, None) for r in CASE_ROWS]
    return spark.createDataFrame(rows, CASES)


def rows_of(df, *order):
    """Rows as tuples in the order of the given columns."""
    rows = [tuple(r) for r in df.collect()]
    if order:
        at = [df.columns.index(c) for c in order]
        rows.sort(key=lambda r: [r[i] for i in at])
    return rows


def plan_of(df) -> str:
    """The physical plan Spark chose, final where the query has run."""
    return df._jdf.queryExecution().executedPlan().toString()
