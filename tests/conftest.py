from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Whether a query and its SQL give the same rows, and how many."""

    def key(frame):
        frame = frame[sorted(frame.columns)].astype(object)
        return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))

    def check(query, sql):
        ours, theirs = query(spark, SF).toPandas(), duck.execute(sql).fetchdf()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert key(ours) == key(theirs)
        return len(ours)

    return check
