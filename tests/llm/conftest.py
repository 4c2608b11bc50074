from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the operators use themselves.
CLASHING = ("node", "component", "score", "shard", "slot", "copy", "n", "set", "label", "bucket")


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns of clashing names."""
    from pyspark.sql import functions as F

    def documents(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).select("*", *(F.lit(7).alias(c) for c in CLASHING))

    return documents


LONG = "word " * 20_000 + "end"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, LONG), (5, LONG), (6, "Ünïcödé — 漢字 \U0001f600 text"), (None, "text without an id but with several words in it"), (7, "x", None, None), (8, "a b c d e f g h")]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    return make(ODD)


@pytest.fixture(scope="session")
def none(make):
    return make(ODD).where("1 = 0")


@pytest.fixture(scope="session")
def texts(spark, sf):
    """doc_id to text of the smallest test tables."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
