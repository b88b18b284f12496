from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from regiolens.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

FACT_DDL = ("record_id long, date date, state string, district string, pincode long, "
            "age_0_5 long, age_5_17 long, age_18_greater long")


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", app="regiolens-tests", extra={"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


def d(y: int, m: int, day: int = 1) -> dt.date:
    return dt.date(y, m, day)


@pytest.fixture
def tiny_fact(spark):
    """12 hand-written rows: 2 states, 3 districts, 3 months."""
    rows = [
        (1, d(2025, 1, 5), "Bihar", "Patna", 800001, 10, 20, 30),
        (2, d(2025, 1, 9), "Bihar", "Patna", 800002, 5, 5, 10),
        (3, d(2025, 1, 9), "Bihar", "Gaya", 823001, 1, 2, 0),
        (4, d(2025, 2, 3), "Bihar", "Patna", 800001, 12, 18, 30),
        (5, d(2025, 2, 3), "Bihar", "Gaya", 823001, 3, 4, 5),
        (6, d(2025, 2, 20), "Gujarat", "Surat", 395001, 50, 60, 70),
        (7, d(2025, 3, 1), "Gujarat", "Surat", 395002, 40, 50, 60),
        (8, d(2025, 3, 1), "Bihar", "Patna", 800001, 9, 11, 20),
        (9, d(2025, 3, 2), "Bihar", "Gaya", 823002, 2, 2, 2),
        (10, d(2025, 3, 15), "Gujarat", "Surat", 395001, 30, 30, 30),
        (11, d(2025, 1, 15), "Gujarat", "Surat", 395003, 25, 25, 50),
        (12, d(2025, 2, 15), "Gujarat", "Surat", 395003, 20, 20, 40),
    ]
    from regiolens.sources.loader import derive_columns

    return derive_columns(spark.createDataFrame(rows, FACT_DDL))
