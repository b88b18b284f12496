from __future__ import annotations

import zlib

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text,
    and extra columns whose names clash with results and internals."""
    rows = [(1, "password=abcDEF123 all rights reserved", "en", "a", 3), (1, "password=abcDEF123 all rights reserved", "en", "a", 3),
            (2, None, None, None, None), (None, "the and of the and", "en", None, 1), (3, "", "de", "b", 0),
            (4, " \t\n ", "de", "b", 4), (5, "word " * 60_000, "en", "a", 300_000), (6, "ü", "de", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as id", "2 as size", "'x' as score", "3 as component_id", "4 as spans", "5 as n", "6 as key")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def crc(x) -> int:
    return zlib.crc32(str(x).encode())
