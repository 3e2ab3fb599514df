from __future__ import annotations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def texts():
    """``doc_id: text`` of the small documents table."""
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with NULLs in every column, empty and long texts, ties, repeated rows and clashing column names."""
    words = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (None, "same text here", "en", "a", 3), (None, None, None, None, None),
        (3, "same text here", "en", "a", 4), (3, "same text here", "en", "a", 4), (4, "same\ttext  here", "fr", None, 5),
        (5, words, "en", "b", 6), (6, words, "en", "b", 6), (7, "∑∂ 123   !!", "de", "b", 1), (8, "x", None, "b", 1),
    ]
    extra = ["t", "fp", "h", "base", "host", "digest", "lang_pred", "toxicity", "_id"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"'extra' as `{c}`" for c in extra])
